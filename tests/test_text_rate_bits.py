"""Text rates: bands of a frame are shuffled as one row."""

from collections import defaultdict

from keepsake.operators.aggregates import text_rate

ROWS = [(1, 1, 0.0, 0.999), (1, 1, 0.5, 0.6), (1, 2, 0.9, 0.1), (1, 3, 0.49, 0.52), (1, None, 0.0, 0.01),
        (2, 1, 0.2, 1.5), (2, 1, -1.0, 0.1), (3, 1, 0.8, 0.2), (None, 1, 0.0, 0.5)]


def expected(rows, frames, n):
    hit, total = defaultdict(set), defaultdict(set)
    for s, f, a, b in rows:
        hit.update({(s, k): hit[s, k] | {f} for k in range(max(0, int(a * n // 1)), min(n - 1, int(b * n // 1)) + 1)})
    for s, f, *_ in frames:
        total[s].add(f)
    return {(s, k): (len(v), len(total[s])) for (s, k), v in hit.items() if s is not None and total[s]}


def test_text_rate_bits(spark):
    lines = spark.createDataFrame(ROWS, "s long, f long, y0 double, y1 double")
    other = spark.createDataFrame([(1, 1), (1, 1), (1, 7), (2, 1)], "s long, f long")
    for frames, rows in ((lines, ROWS), (other, [(1, 1), (1, 1), (1, 7), (2, 1)])):
        for n in (24, 62, 70, 130):
            got = text_rate(lines, frames, "s", "f", "y0", "y1", n).collect()
            assert {(r.s, r.band): (r.frames_seen, r.frames) for r in got} == expected(ROWS, rows, n)
            assert len(got) == len({(r.s, r.band) for r in got})


def test_one_row_per_frame_is_shuffled(spark):
    lines = spark.createDataFrame(ROWS, "s long, f long, y0 double, y1 double")
    plan = text_rate(lines, lines, "s", "f", "y0", "y1")._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence" not in plan
    assert plan.count("hashpartitioning(s#") == 2       # by series and frame, then by series
