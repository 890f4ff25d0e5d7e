"""Prefix trie of conversations by union-find over the LCP edges of sorted neighbours.

Every turn is named by the MD5 of its role and text, a conversation is the sequence of those names, and equal sequences
are one item with its number of copies. Items are range-partitioned and sorted by their sequences. Neighbours are joined
by edges weighted with the length of their longest common prefix (LCP). Taking the edges in descending depth, union-find
merges runs of neighbours: every merge of a depth is a branching node, and what was merged hangs below it on a chain of
nodes without branches, complete except for the nodes on the paths of a partition's first and last sequence, which other
partitions may share. A partition forest is contracted to these two paths: one *bundle* sums up all that hangs below a
node of them. Contracted forests of 64 neighbouring partitions are sorted together and merged by the same union-find,
round after round, until one is left and its paths are complete too. A task reads its partition in blocks and contracts
what it has after each block, so it holds one block and two paths.

Chains of one item alone are only noted (item, first depth) and spelled out at the end from the item's own turns.

Long conversations are cut into segments of ``SEGMENT`` turns. An item takes part with the last segment that starts in
common with another one; groups of items that share all of a segment enter the level above as one bundle. Deeper levels
come first; nearly always there is one.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.ranks import shared_write

SEGMENT = 4096
BLOCK = 4096
FAN = 64
SHARED_TURNS = 4
HOSTS = 20
NAME = 16       # bytes of a turn's name
IDS_A_ROW = 256
ROWS_A_BATCH = 1 << 16
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---- turns in order -------------------------------------------------------------------------------------------------

def ordered_turns(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """``conv_id, pos, name, words``: turns by conversation, numbered from 0 by (turn, null first; name).

    Rows are cut into sorted ranges, so that a conversation of any length is spread over tasks; each task numbers its
    rows, and the few conversations that cross a range's end get the rows before it added.
    """
    spark = turns.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))      # noqa: E731
    named = shared_write(turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))).alias("name"),
        F.regexp_count(text("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("name")]
    count = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = (named.repartitionByRange(count, *order).sortWithinPartitions(*order)
               .withColumn("part", F.spark_partition_id()))

    def run(batches):
        conv, n = None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            place = np.arange(len(ids)) - np.repeat(begin, np.diff(np.r_[begin, len(ids)]))
            if ids[0] == conv:
                place[:begin[1] if len(begin) > 1 else len(ids)] += n
            conv, n = ids[-1], place[-1] + 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(place), batch.column("name"),
                                              batch.column("words"), batch.column("part")],
                                             ["conv_id", "place", "name", "words", "part"])

    placed = shared_write(sorted_.select("conv_id", "name", "words", "part").mapInArrow(
        run, "conv_id long, place long, name string, words long, part int"))
    ends = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one conversation crosses each end of a range
    carried = ends.withColumn("before", F.sum("n").over(before)).filter("before IS NOT NULL").drop("n")
    return placed.join(F.broadcast(carried), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "name", "words")


def shared_head(conv: Column, heads: int = SHARED_TURNS) -> Column:
    """How many turns a conversation takes from its host."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(heads)).cast("long")


def rebuilt_turns(turns: DataFrame, hosts: int = HOSTS, heads: int = SHARED_TURNS) -> tuple[DataFrame, DataFrame]:
    """All conversations, and the turns of the rebuilt ones: ``conv_id``; ``conv_id, depth`` (from 1)``, name, words``.

    The first turns come from the host, the conversation with the id ``conv_id - conv_id % hosts``.
    """
    placed = shared_write(ordered_turns(turns))
    sizes = shared_write(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
                         .withColumn("h", shared_head(F.col("conv_id"), heads))
                         .withColumn("host", F.col("conv_id") - F.col("conv_id") % hosts))
    of_host = sizes.select(F.col("conv_id").alias("host"), F.col("n").alias("host_n"))
    lack = (sizes.join(of_host, "host", "left")
            .withColumn("lack", F.col("h") - F.least("h", F.coalesce("host_n", F.lit(0)))))
    head = placed.filter((F.col("pos") < heads - 1) & (F.col("conv_id") % hosts == 0)).withColumnRenamed("conv_id", "host")
    taken = sizes.join(head, "host").filter("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "name", "words")
    # a short host leaves a gap; one row for each block of turns, so that long conversations meet it in many tasks
    gaps = lack.select("conv_id", "lack", F.explode(F.sequence(F.lit(0), F.expr("n div 4096"))).alias("block"))
    rest = (placed.filter(F.col("pos") >= shared_head(F.col("conv_id"), heads))
            .withColumn("block", F.expr("pos div 4096")).join(gaps, ["conv_id", "block"])
            .select("conv_id", (F.col("pos") + 1 - F.col("lack")).alias("depth"), "name", "words"))
    return sizes.select("conv_id"), taken.unionByName(rest)


# ---- union-find -----------------------------------------------------------------------------------------------------

@dataclass(eq=False)
class Item:
    """A whole sequence with its copies (``alone``), or a bundle of all that hangs below the node ``names``.

    ``cum[i]`` counts the words up to and with the first i names, those of earlier segments included.
    """

    group: bytes            # what all sequences of a group share before this segment
    names: bytes
    cum: np.ndarray
    members: int
    least: int              # smallest conv_id
    unit: int | None        # smallest conv_id of the copies that end at the node
    alone: bool = False
    length: int = 0         # turns and words of the whole sequence, which may go on beyond this segment
    words: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0          # summed over the nodes below


@dataclass(eq=False)
class _Run:
    """Merged neighbours: their top node is ``depth`` names of ``item`` deep."""

    item: Item
    depth: int
    members: int
    least: int
    unit: int | None
    children: int
    leaves: int
    saved: int
    alone: bool
    noted: bool = False     # has been open before: nodes below may know it by its key only

    @classmethod
    def of(cls, i: Item) -> _Run:
        return cls(i, len(i.names) // NAME, i.members, i.least, i.unit, i.children, i.leaves, i.saved, i.alone,
                   not i.alone)


def _lcp(a: bytes, b: bytes) -> int:
    """Names that two sequences start with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // NAME
    if a[:NAME] != b[:NAME]:
        return 0
    return int((np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)).argmax()) // NAME


def _key(item: Item, depth: int) -> bytes:
    return hashlib.md5(item.group + b"/" + item.names[:depth * NAME]).digest()


class Forest:
    """Union-find over sorted items; collects complete nodes, chains of one sequence, and groups below ``base`` turns."""

    def __init__(self, base: int, top_id: int):
        self.base, self.top_id = base, top_id
        self.nodes: list[tuple] = []    # key, conv, depth, parent, parent_key, members, children, leaves, saved, unit
        self.chains: list[tuple] = []   # unit, first depth, parent, parent_key
        self.tops: list[tuple] = []     # group, least, members, children, leaves, saved

    def _close(self, run: _Run, above: int, parent: int | None, key: bytes | None) -> None:
        """All nodes of a complete run deeper than ``above``, where its parent is."""
        if run.alone:
            self.chains.append((run.unit, self.base + above + 1, parent, key))
            return
        cum, leaves = run.item.cum, run.leaves if run.children else 1
        for depth in range(above + 1, run.depth + 1):
            last, first = depth == run.depth, depth == above + 1
            self.nodes.append((
                _key(run.item, depth) if last and run.noted else None, run.least, self.base + depth,
                parent if first else run.least, key if first else None, run.members, run.children if last else 1, leaves,
                run.saved + (run.members - 1) * int(cum[run.depth] - cum[depth - 1]), run.unit if last else None))

    def _fold(self, runs: list[_Run], depth: int, open_: bool) -> _Run:
        """The node that all ``runs`` pass at ``depth``; what goes on below it is closed."""
        least, item = min(r.least for r in runs), runs[0].item
        parent, key = least, None
        if self.base + depth == 0:
            parent = self.top_id
        elif open_ or depth == 0:       # the node is not complete here, or belongs to the level above
            parent, key = None, _key(item, depth)
        out = _Run(item, depth, sum(r.members for r in runs), least, None, 0, 0, 0, False)
        for r in runs:
            if r.depth == depth and not (r.alone and r.item.length > self.base + depth):
                out.children, out.leaves, out.saved = out.children + r.children, out.leaves + r.leaves, out.saved + r.saved
                out.unit = r.unit if out.unit is None else out.unit
                out.noted |= r.noted
            else:
                to = r.item.words if r.alone else r.item.cum[r.depth]
                out.children, out.leaves = out.children + 1, out.leaves + (r.leaves if r.children else 1)
                out.saved += r.saved + (r.members - 1) * int(to - r.item.cum[depth])
                self._close(r, depth, parent, key)
        return out

    def _finish(self, run: _Run) -> None:
        """A complete group: its first node is the root, or is what the level above hangs on."""
        top = run if run.depth == 0 and not run.alone else self._fold([run], 0, False)
        leaves = top.leaves if top.children else 1
        if self.base:
            self.tops.append((top.item.group, top.least, top.members, top.children, top.leaves, top.saved))
        else:
            self.nodes.append((None, top.least, 0, None, None, top.members, top.children, leaves, top.saved, top.unit))

    def contract(self, items: list[Item], open_: tuple[Item, ...]) -> list[Item]:
        """Merge ``items`` in descending depth of their neighbours' LCP.

        ``open_`` are the first and the last sequence if others may come before and behind; they and the bundles on
        their paths are returned. Without them everything is complete.
        """
        items = sorted(items, key=lambda i: (i.group, i.names, i.alone))
        depths = np.array([_lcp(a.names, b.names) if a.group == b.group else -1 for a, b in zip(items, items[1:])], int)
        held = {id(i) for i in open_}
        runs = [None if id(i) in held else _Run.of(i) for i in items]
        paths = [[i] if id(i) in held else [] for i in items]       # open sequences of a component, by its root
        root = list(range(len(items)))                              # components are intervals, their root comes first

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        left: list[Item] = list(open_[:1] if len(held) == 1 else open_)
        for depth in sorted(set(depths[depths >= 0].tolist()), reverse=True):
            edges = np.flatnonzero(depths == depth).tolist()
            at = 0
            while at < len(edges):
                parts = [find(edges[at])]
                while at < len(edges) and find(edges[at]) == parts[-1]:
                    parts.append(find(edges[at] + 1))
                    at += 1
                whole = [runs[p] for p in parts if runs[p] is not None]
                on = [i for p in parts for i in paths[p]]
                top = parts[0]
                for p in parts[1:]:
                    root[p] = top
                paths[top], runs[top] = on, None
                if not on:
                    runs[top] = self._fold(whole, depth, False)
                elif whole:
                    r = self._fold(whole, depth, True)
                    left.append(Item(on[0].group, on[0].names[:depth * NAME], on[0].cum[:depth + 1], r.members, r.least,
                                     r.unit, False, 0, 0, r.children, r.leaves, r.saved))
        for i, run in enumerate(runs):
            if root[i] == i and run is not None:
                self._finish(run)
        return left


# ---- levels ---------------------------------------------------------------------------------------------------------

_ITEMS = ("group binary, names binary, words array<long>, before long, members long, least long, unit long, alone boolean,"
          " length long, total long, children long, leaves long, saved long")
_OUT = ("kind string, key binary, conv long, depth long, parent long, parent_key binary, members long, children long,"
        " leaves long, saved long, unit long, part long, forest binary")
_OUT_TYPES = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("conv", pa.int64()), ("depth", pa.int64()),
                        ("parent", pa.int64()), ("parent_key", pa.binary()), ("members", pa.int64()),
                        ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("unit", pa.int64()),
                        ("part", pa.int64()), ("forest", pa.binary())])


def _drained(forest: Forest, part: int | None = None, left: tuple | None = None) -> pa.RecordBatch:
    """What is complete, and the open rest of a part, as rows of ``_OUT``."""
    rows = [("node", *n, None, None) for n in forest.nodes]
    rows += [("chain", None, None, depth, parent, key, None, None, None, None, unit, None, None)
             for unit, depth, parent, key in forest.chains]
    rows += [("top", group, least, None, None, None, members, children, leaves, saved, None, None, None)
             for group, least, members, children, leaves, saved in forest.tops]
    if left is not None:
        rows.append(("forest", *[None] * 10, part, pickle.dumps(left)))
    forest.nodes, forest.chains, forest.tops = [], [], []
    columns = zip(*rows) if rows else [()] * len(_OUT_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _OUT_TYPES)], schema=_OUT_TYPES)


def _merge_partitions(items: DataFrame, base: int, top_id: int, block: int) -> DataFrame:
    """Complete rows of each sorted partition, and one contracted forest for each."""

    def run(batches):
        forest, left, first, last, part = Forest(base, top_id), [], None, None, None

        def contract(new):
            nonlocal first, last, left
            first = first or new[0]
            last = new[-1]
            left = forest.contract(left + new, (first, last) if first is not last else (first,))
            return _drained(forest)

        new = []
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for r in batch.drop_columns(["part"]).to_pylist():
                cum = np.cumsum([r["before"], *r["words"]])
                new.append(Item(r["group"], r["names"], cum, r["members"], r["least"], r["unit"], r["alone"], r["length"],
                                r["total"], r["children"], r["leaves"], r["saved"]))
                if len(new) == block:
                    yield contract(new)
                    new = []
        if new:
            yield contract(new)
        if first is not None:
            yield _drained(forest, part, (left, first, last))

    order = ["group", "names", "alone", "least"]
    count = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = items.repartitionByRange(count, *order).sortWithinPartitions(*order)
    return sorted_.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, _OUT)


def _merge_forests(forests: DataFrame, base: int, top_id: int, final: bool, fan: int) -> DataFrame:
    """``fan`` neighbouring forests become one; the last one is complete."""

    def run(table: pa.Table) -> pa.Table:
        forest, items, ends = Forest(base, top_id), [], []
        for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
            left, first, last = pickle.loads(row["forest"])
            items += left
            ends += [first, last]
        first, last = ends[0], ends[-1]
        left = forest.contract(items, () if final else (first, last) if first is not last else (first,))
        rest = None if final else (left, first, last)
        return pa.Table.from_batches([_drained(forest, table.column("next")[0].as_py(), rest)])

    return forests.withColumn("next", F.expr(f"part div {fan}")).groupBy("next").applyInArrow(run, _OUT)


def _level(items: DataFrame, base: int, top_id: int, block: int, fan: int) -> DataFrame:
    """All complete rows of one level."""
    out = [shared_write(_merge_partitions(items, base, top_id, block))]
    most = out[0].agg(F.max("part")).first()[0]
    while most is not None:
        final = most < fan
        forests = out[-1].filter("kind = 'forest'").select("part", "forest")
        out.append(shared_write(_merge_forests(forests, base, top_id, final, fan)))
        most = None if final else most // fan
    return reduce(DataFrame.unionByName, out).filter("kind <> 'forest'").drop("part", "forest")


def _units(copies: DataFrame) -> DataFrame:
    """``unit, members, length, total, ends_sha256`` of each distinct sequence.

    Ids are sorted in ranges and joined in short lists there; the lists of one sequence are hashed one after the other
    in one task, which holds none but the one at hand.
    """
    order = ["seq", "conv_id"]
    count = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def listed(batches):
        for batch in batches:
            seq, ids = batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()
            begin = [i for i in range(len(seq)) if not i or seq[i] != seq[i - 1]]
            begin = [j for i, to in zip(begin, [*begin[1:], len(seq)]) for j in range(i, to, IDS_A_ROW)]
            ends = [min([e for e in (b + IDS_A_ROW, nxt) if e]) for b, nxt in zip(begin, [*begin[1:], len(seq)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([seq[b] for b in begin], pa.string()), pa.array([ids[b] for b in begin], pa.int64()),
                 pa.array([e - b for b, e in zip(begin, ends)], pa.int64()),
                 pa.array([",".join(map(str, ids[b:e])) for b, e in zip(begin, ends)], pa.string()),
                 batch.column("length").take(pa.array(begin, pa.int64())),
                 batch.column("total").take(pa.array(begin, pa.int64()))],
                ["seq", "first", "n", "ids", "length", "total"])

    def hashed(batches):
        now, sha = None, None

        def row():
            return pa.RecordBatch.from_pylist([dict(now, ends_sha256=sha.hexdigest())], schema=types)

        types = pa.schema([("unit", pa.int64()), ("members", pa.int64()), ("length", pa.int64()), ("total", pa.int64()),
                           ("ends_sha256", pa.string())])
        at = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["seq"] != at:
                    if at is not None:
                        done.append(dict(now, ends_sha256=sha.hexdigest()))
                    at, sha = r["seq"], hashlib.sha256(r["ids"].encode())
                    now = {"unit": r["first"], "members": r["n"], "length": r["length"], "total": r["total"]}
                else:
                    sha.update(b"," + r["ids"].encode())
                    now["members"] += r["n"]
            yield pa.RecordBatch.from_pylist(done, schema=types)
        if at is not None:
            yield row()

    lists = copies.repartitionByRange(count, *order).sortWithinPartitions(*order).mapInArrow(
        listed, "seq string, first long, n long, ids string, length long, total long")
    return lists.repartition(count, "seq").sortWithinPartitions("seq", "first").mapInArrow(
        hashed, "unit long, members long, length long, total long, ends_sha256 string")


def _spelled(chains: DataFrame) -> DataFrame:
    """The nodes of the chains: one row for each turn of a sequence from ``from`` on."""

    def nodes(rows: list[dict], depths: list[np.ndarray], sums: list[np.ndarray]) -> pa.RecordBatch:
        n = [len(d) for d in depths]
        spread = lambda name: np.repeat(np.array([r[name] or 0 for r in rows], np.int64), n)     # noqa: E731
        depth, unit = np.concatenate(depths), spread("unit")
        first, last = depth == spread("from"), depth == spread("length")
        known = np.repeat([r["parent"] is not None for r in rows], n)
        keys = pa.array([r["parent_key"] for r in rows], pa.binary())
        return pa.RecordBatch.from_arrays([
            pa.array(unit), pa.array(depth), pa.array(np.where(first, spread("parent"), unit), mask=first & ~known),
            keys.take(pa.array(np.repeat(np.arange(len(rows)), n), mask=~first)), pa.array(spread("members")),
            pa.array(np.where(last, 0, 1)), pa.array(np.ones(len(depth), np.int64)),
            pa.array((spread("members") - 1) * (spread("total") - np.concatenate(sums))), pa.array(unit, mask=~last)],
            ["conv", "depth", "parent", "parent_key", "members", "children", "leaves", "saved", "unit"])

    def run(batches):
        for batch in batches:
            rows, depths, sums, held = [], [], [], 0
            for r in batch.to_pylist():
                base = r["seg"] * r["size"]
                low, high = max(r["from"], base + 1), base + len(r["words"])
                rows.append(r)
                depths.append(np.arange(low, high + 1))
                sums.append(np.cumsum([r["before"], *r["words"]])[low - 1 - base:high - base])
                held += len(depths[-1])
                if held > ROWS_A_BATCH:
                    yield nodes(rows, depths, sums)
                    rows, depths, sums, held = [], [], [], 0
            if rows:
                yield nodes(rows, depths, sums)

    return chains.mapInArrow(run, "conv long, depth long, parent long, parent_key binary, members long, children long,"
                                  " leaves long, saved long, unit long")


def prefix_trie(turns: DataFrame, hosts: int = HOSTS, heads: int = SHARED_TURNS, segment: int = SEGMENT,
                block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``. Turns are ordered by ``turn``, null first, turns of one number by the MD5 of role
    and text; a repeated row is a turn of its own. Null role or text is empty. Rows without ``conv_id`` belong to no
    conversation and are left out; ``conv_id % 20`` has the sign of ``conv_id``. Other columns are ignored; an empty table
    gives an empty one. A text of any length is one MD5 and one count of words.
    """
    convs, rebuilt = rebuilt_turns(turns, hosts, heads)
    rows = rebuilt.withColumn("seg", F.expr(f"(depth - 1) div {segment}"))
    cut = shared_write(rows.groupBy("conv_id", "seg").agg(
        F.sort_array(F.collect_list(F.struct("depth", "name", "words"))).alias("t")).select(     # ``segment`` at most
        "conv_id", "seg", F.unhex(F.array_join("t.name", "")).alias("names"), F.col("t.words").alias("words")))
    whole = cut.groupBy("conv_id").agg(
        F.md5(F.array_join(F.sort_array(F.collect_list(F.struct("seg", F.md5("names").alias("m")))).m, "").cast("binary"))
        .alias("seq"), F.sum(F.size("words")).alias("length"),
        F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    copies = shared_write(convs.join(whole, "conv_id", "left").select(
        "conv_id", F.coalesce("seq", F.lit("")).alias("seq"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c)
                                                                for c in ("length", "total"))))
    units = shared_write(_units(copies))
    top_id = copies.agg(F.min("conv_id")).first()[0]
    empty = turns.sparkSession.createDataFrame([], _OUT).drop("part", "forest")
    if top_id is None:
        return _finished(empty, units, empty, [])

    own = Window.partitionBy("unit").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sizes = units.drop("ends_sha256")
    parts = sizes.join(cut.withColumnRenamed("conv_id", "unit"), "unit", "left").select(
        "unit", "members", "length", "total", F.coalesce("seg", F.lit(0).cast("long")).alias("seg"),
        F.coalesce("names", F.lit(b"")).alias("names"), F.coalesce("words", F.array().cast("array<long>")).alias("words"))
    half = lambda salt: F.bit_xor(F.xxhash64("seg", "names", F.lit(salt))).over(own).cast("string")
    parts = shared_write(parts.withColumn(
        "before", F.coalesce(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)).over(own), F.lit(0)))
        .withColumn("group", F.concat_ws(":", half(1), half(2)).cast("binary")))
    met = parts.filter("seg > 0").groupBy("seg", "group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entry = shared_write(parts.join(met, ["seg", "group"]).groupBy("unit").agg(F.max("seg").alias("entry")))
    deepest = entry.agg(F.max("entry")).first()[0] or 0
    levels: list[DataFrame] = []
    aliases = []        # the first node of a group has a key of its own in the level above
    for seg in range(deepest, -1, -1):
        here = parts.filter(F.col("seg") == seg)
        alone = here.join(entry, "unit", "left").filter(F.coalesce("entry", F.lit(0)) == seg).select(
            "group", "names", "words", "before", "members", F.col("unit").alias("least"), "unit",
            F.lit(True).alias("alone"), "length", "total", *(F.lit(0).cast("long").alias(c)
                                                             for c in ("children", "leaves", "saved")))
        if levels:
            below = levels[-1].filter("kind = 'top'").select(
                F.col("key").alias("below"), F.col("conv").alias("unit"), "members", "children", "leaves", "saved")
            hung = below.join(here.drop("members"), "unit")
            slash = F.lit(b"/")
            aliases.append(hung.select(F.unhex(F.md5(F.concat("below", slash))).alias("alias"),
                                       F.unhex(F.md5(F.concat("group", slash, "names"))).alias("parent_key")))
            bundles = hung.select(
                "group", "names", "words", "before", "members", F.col("unit").alias("least"),
                F.lit(None).cast("long").alias("unit"), F.lit(False).alias("alone"), F.lit(0).cast("long").alias("length"),
                F.lit(0).cast("long").alias("total"), "children", "leaves", "saved")
            alone = alone.unionByName(bundles)
        levels.append(_level(alone, seg * segment, top_id, block, fan))
    nodes = reduce(DataFrame.unionByName, levels)
    chains = nodes.filter("kind = 'chain'").select("unit", F.col("depth").alias("from"), "parent", "parent_key")
    spelled = _spelled(parts.join(chains, "unit").filter(F.col("seg") >= F.expr(f"(from - 1) div {segment}")).select(
        "unit", "seg", "words", "before", "members", "length", "total", "from", "parent", "parent_key",
        F.lit(segment).alias("size")))
    return _finished(nodes.filter("kind = 'node'"), units, spelled, aliases)


def _finished(nodes: DataFrame, units: DataFrame, spelled: DataFrame, aliases: list[DataFrame]) -> DataFrame:
    """Nodes and spelled chains with the ids of parents that were known by key, and hashes of those that end."""
    columns = ["conv", "depth", "parent", "parent_key", "members", "children", "leaves", "saved", "unit"]
    rows = nodes.select(*columns).unionByName(spelled.select(*columns))
    keyed = nodes.filter("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv").alias("found"))
    for a in aliases:
        keyed = keyed.unionByName(keyed.join(a, "parent_key").select(F.col("alias").alias("parent_key"), "found"))
    known = rows.filter("parent_key IS NULL").withColumn("found", F.col("parent"))
    asked = rows.filter("parent_key IS NOT NULL").join(keyed, "parent_key")
    both = known.unionByName(asked)
    shas = units.select("unit", "ends_sha256")
    ended = both.filter("unit IS NOT NULL").join(shas, "unit")
    passed = both.filter("unit IS NULL").withColumn("ends_sha256", F.lit(_EMPTY_SHA))
    return ended.unionByName(passed).select(
        F.col("conv").alias("conv_id"), "depth", F.col("found").alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        "ends_sha256")
