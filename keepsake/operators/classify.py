"""Filing decisions, category hygiene, prompt selection and clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import text as X
from keepsake.operators.blocks import row_index, running, top_n
from keepsake.operators.joins import nearest_bounds


def number_units(units: DataFrame, item: str, order: list[str], block: Column) -> DataFrame:
    """1-based number of each unit of an item by start."""
    return row_index(units, [item], order, block, "n")


# ---- routing --------------------------------------------------------------

def name_forms(name: Column) -> Column:
    """Every name that counts as the same bucket: itself, minus or plus one generic suffix."""
    return F.array_distinct(F.array_compact(F.concat(
        F.array(name, X.base_name(name)), *[F.array(F.concat(name, F.lit(t))) for t in X.GENERIC_TAILS])))


def same_name(a: Column, b: Column) -> Column:
    """Names equal, or equal up to one generic suffix."""
    return F.coalesce((a != "") & (b != "") & (
        (a == b) | (X.base_name(a) == b) | (X.base_name(b) == a)), F.lit(False))


def route(items: DataFrame, verdicts: DataFrame, categories: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Filing decision per item: ``action`` (filed, proposed, inbox), category, note.

    ``items(id, domain, rule_category_id, rule_owner_name)`` (see ``owner_rule``),
    ``verdicts(item_id, category_id, new_name, confidence, reason)``,
    ``categories(id, domain, name, status)``. ``new_category`` names a bucket to create.
    """
    given = F.nullif(F.col("new_name"), F.lit(""))
    whole = F.coalesce("reason", F.lit(""))
    text = F.substring(whole, 1, 200)       # what is stored
    quoted = "[「」\"']+"
    name = F.substring(F.regexp_replace(X.strip(F.coalesce(given, X.proposal_name(whole))),
                                        f"^{quoted}|{quoted}$", ""), 1, 40)
    v = verdicts.select(F.col("item_id").alias("id"), F.col("category_id").alias("v_category"),
                        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), text.alias("reason"),
                        (given.isNotNull() | X.proposal_strong(whole).isNotNull()).alias("_explicit"),
                        F.nullif(name, F.lit("")).alias("_name"))
    active = categories.filter(F.col("status") == "active").select(
        F.col("id").alias("v_category"), "domain", F.lit(True).alias("v_active"))
    d = items.join(v, "id", "left").join(active, ["v_category", "domain"], "left")
    by_rule = F.col("rule_category_id").isNotNull()
    sure = F.col("confidence") >= threshold
    direct = F.coalesce(F.col("v_active"), F.lit(False)) & sure
    accept = F.coalesce(F.col("_explicit") | (F.col("confidence") >= min(threshold, 0.5)), F.lit(False))
    d = d.withColumn("proposal", F.when(~by_rule & ~direct & accept, F.col("_name")))
    # Every living category is found under each form of its name; the smallest id wins.
    found = (categories.filter(F.col("status") != "archived")
             .select("domain", F.explode(name_forms(F.col("name"))).alias("proposal"),
                     F.struct(F.col("id").alias("_cid"), F.col("status").alias("_cstatus")).alias("_c"))
             .groupBy("domain", "proposal").agg(F.min("_c").alias("_e")))
    d = d.join(found, ["domain", "proposal"], "left")
    known = F.col("_e").isNotNull()
    reuse = known & (F.col("_e._cstatus") == "active") & sure
    reason = F.coalesce("reason", F.lit(""))
    action = (F.when(by_rule | direct, "filed").when(F.col("proposal").isNull(), "inbox")
              .when(reuse, "filed").otherwise("proposed"))
    # Note texts.
    note = (F.when(by_rule, F.concat(F.lit("UP主规则:"), "rule_owner_name", F.lit(" 的视频归入本分类")))
            .when(direct | reuse, reason)
            .when(F.col("proposal").isNull(), F.concat(F.lit("未分类:"), reason))
            .when(known, F.concat(F.lit("命中已有分类「"), "proposal", F.lit("」。"), reason))
            .otherwise(F.concat(F.lit("提议新分类:"), "proposal", F.lit("。"), reason)))
    return d.select(
        "id", "domain", action.alias("action"),
        F.when(by_rule, F.col("rule_category_id")).when(direct, F.col("v_category"))
        .when(F.col("proposal").isNotNull(), F.col("_e._cid")).alias("category_id"),
        F.when(F.col("proposal").isNotNull() & ~known, F.col("proposal")).alias("new_category"),
        F.when(by_rule, F.lit(1.0)).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        note.alias("note"))


def proposed_categories(routed: DataFrame) -> DataFrame:
    """The categories to create: one per domain and proposed name, id from its content."""
    return routed.filter(F.col("new_category").isNotNull()).select(
        "domain", F.col("new_category").alias("name")).distinct().withColumns({
            "id": F.xxhash64("domain", "name"), "status": F.lit("proposed")})


# ---- category hygiene -----------------------------------------------------

def variant_names(categories: DataFrame) -> DataFrame:
    """Pairs of distinct names of a domain where the second is the first plus one suffix."""
    names = categories.select("domain", "name").distinct()
    long = names.select("domain", F.col("name").alias("variant"), X.base_name("name").alias("name")).filter(
        F.col("name").isNotNull())
    return long.join(names, ["domain", "name"]).select("domain", "name", "variant")


def name_roots(categories: DataFrame) -> DataFrame:
    """Shortest variant each name leads to through existing names of its domain.

    A name has at most one shorter variant, so its chain of shorter forms is a path; the
    root is the last form before the first missing one.
    """
    names = categories.select("domain", "name").distinct()
    chain = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length("name") / 2).cast("int"))), F.array("name"),
        lambda acc, _: F.when(X.base_name(F.element_at(acc, -1)).isNotNull(), F.concat(
            acc, F.array(X.base_name(F.element_at(acc, -1))))).otherwise(acc))
    forms = names.select("domain", F.col("name").alias("start"), F.posexplode(chain).alias("pos", "name"))
    there = names.withColumn("_there", F.lit(True))
    known = forms.join(there, ["domain", "name"], "left")
    gap = known.groupBy("domain", "start").agg(
        F.min(F.when(F.col("_there").isNull(), F.col("pos"))).alias("_gap"))
    return (known.join(gap, ["domain", "start"]).filter(
        F.col("_gap").isNull() | (F.col("pos") < F.col("_gap")))
        .groupBy("domain", "start").agg(F.max_by("name", "pos").alias("root"))
        .withColumnRenamed("start", "name"))


def dedupe_categories(categories: DataFrame, items: DataFrame) -> DataFrame:
    """Keeper of every category: active first, shortest name, most items, smallest id.

    ``items(category_id)``. Returns ``(id, keeper_id)``; a keeper keeps itself.
    """
    n = items.groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("_items"))
    c = categories.join(name_roots(categories), ["domain", "name"]).join(n, "id", "left").withColumn(
        "_items", F.coalesce("_items", F.lit(0)))
    keeper = top_n(c, ["domain", "root"], [
        F.when(F.col("status") == "active", 0).otherwise(1), F.length("name"), F.desc("_items"), F.col("id")], 1)
    return c.select("id", "domain", "root").join(
        keeper.select("domain", "root", F.col("id").alias("keeper_id")), ["domain", "root"]).select("id", "keeper_id")


def remap(children: DataFrame, keepers: DataFrame, key: str = "category_id") -> DataFrame:
    """Point children of merged categories to the keeper."""
    k = keepers.select(F.col("id").alias(key), "keeper_id")
    return children.join(k, key, "left").withColumn(key, F.coalesce("keeper_id", key)).drop("keeper_id")


# ---- prompts --------------------------------------------------------------

def number_versions(log: DataFrame, key: str, order: list[str], block: Column) -> DataFrame:
    """Version number per key along the log; the newest version is active, others retired."""
    one = F.lit(1).cast("long")
    rows = running(log, [key], order, block, sums={"version": one}, totals={"_max": one})
    return rows.withColumn("status", F.when(
        F.col("version") == F.col("_max"), "active").otherwise("retired")).drop("_max")


def rollback(log: DataFrame, targets: DataFrame, key: str, version: str = "version") -> DataFrame:
    """A rollback appends the old content as the newest version. ``targets(key, version)``."""
    old = log.join(targets, [key, version]).select(key, "content")
    top = log.groupBy(key).agg(F.max(version).alias("_top"))
    new = old.join(top, key).select(key, (F.col("_top") + 1).cast("long").alias(version), "content",
                                    F.lit("active").alias("status"), F.lit("rollback").alias("origin"))
    touched = targets.select(key).distinct().withColumn("_t", F.lit(True))
    kept = log.join(touched, key, "left").withColumn("status", F.when(
        F.col("_t") & (F.col("status") == "active"), "retired").otherwise(F.col("status"))).drop("_t")
    return kept.unionByName(new, allowMissingColumns=True)


def select_prompt(items: DataFrame, prompts: DataFrame) -> DataFrame:
    """Rule profile, else the category's own prompt, else the generic one.

    ``items(id, profile, category_id)``, ``prompts(name, category_id, version, status)``.
    """
    live = prompts.filter(F.col("status") == "active")
    by_name = live.filter(F.col("name") != "extract").select(
        F.col("name").alias("profile"), F.col("version").alias("_p"))
    by_cat = live.filter((F.col("name") == "extract") & F.col("category_id").isNotNull()).select(
        "category_id", F.col("version").alias("_c"))
    generic = live.filter((F.col("name") == "extract") & F.col("category_id").isNull()).agg(
        F.max("version").alias("_g"))
    out = items.join(by_name, "profile", "left").join(by_cat, "category_id", "left").join(F.broadcast(generic))
    return out.select("id", F.when(F.col("_p").isNotNull(), "profile").when(
        F.col("_c").isNotNull(), "category").otherwise("generic").alias("source"),
        F.coalesce("_p", "_c", "_g").alias("version"))


def upgrade_seeds(prompts: DataFrame, factory: list[str], content: str) -> DataFrame:
    """Active prompts that still carry a factory text move to the new one."""
    old = (F.col("status") == "active") & X.strip("content").isin(*[f.strip() for f in factory])
    return prompts.withColumns({
        "origin": F.when(old, "upgrade").otherwise(F.col("origin")),
        "version": F.when(old, F.col("version") + 1).otherwise(F.col("version")),
        "content": F.when(old, content).otherwise(F.col("content"))})


# ---- clips ----------------------------------------------------------------

CLIP_KIND = "片段"


def clips_from_units(refs: DataFrame, numbered_units: DataFrame, item: str) -> DataFrame:
    """Unit references to time spans: unknown units dropped, reversed ones fixed, the first
    of equal spans kept.

    ``refs(item, ref_id, from_unit, to_unit, kind, confidence)`` with unit numbers as text,
    ``numbered_units(item, n, lo, hi)``.
    """
    a = F.col("from_unit").try_cast("long")
    b = F.when(F.col("to_unit").isNull(), a).otherwise(F.col("to_unit").try_cast("long"))
    r = refs.select(item, "ref_id", F.least(a, b).alias("n1"), F.greatest(a, b).alias("n2"),
                    F.coalesce("kind", F.lit(CLIP_KIND)).alias("kind"), "confidence").filter(a.isNotNull() & b.isNotNull())
    first = numbered_units.select(item, F.col("n").alias("n1"), F.bround("lo", 2).alias("start_ts"))
    last = numbered_units.select(item, F.col("n").alias("n2"), F.bround(F.coalesce("hi", "lo"), 2).alias("end_ts"))
    spans = r.join(first, [item, "n1"]).join(last, [item, "n2"])
    return spans.groupBy(item, "start_ts", "end_ts").agg(
        F.min_by(F.struct("kind", "confidence"), "ref_id").alias("_c")).select(
        item, "start_ts", "end_ts", "_c.kind", "_c.confidence")


def snap_clips(clips: DataFrame, bounds: DataFrame, item: str, block: float, min_seconds: float = 0.5) -> DataFrame:
    """Start to the largest bound at or before it, end to the smallest at or after it.

    Items without bounds keep their clips. ``clips(item, clip_id, start_ts, end_ts, ...)``,
    ``bounds(item, b)``.
    """
    valid = clips.filter((F.col("start_ts") >= 0) & (F.col("end_ts") >= 0)
                         & (F.col("end_ts") - F.col("start_ts") >= min_seconds))
    b = bounds.select(item, "b")        # repeated bounds change nothing
    ends = b.groupBy(item).agg(F.min("b").alias("_first"), F.max("b").alias("_last"))
    points = valid.select(item, "clip_id", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("start_ts").alias("x")),
        F.struct(F.lit(1).alias("side"), F.col("end_ts").alias("x")))).alias("p")).select(item, "clip_id", "p.*")
    near = nearest_bounds(points, b, item, "x", "b", block).groupBy(item, "clip_id").agg(
        F.max(F.when(F.col("side") == 0, F.col("below"))).alias("_below"),
        F.max(F.when(F.col("side") == 1, F.col("above"))).alias("_above"))
    out = valid.join(near, [item, "clip_id"]).join(ends, item, "left")
    return out.withColumns({
        "start_ts": F.coalesce("_below", "_first", "start_ts"),
        "end_ts": F.coalesce("_above", "_last", "end_ts")}).filter(
        F.col("end_ts") - F.col("start_ts") >= min_seconds).drop("_below", "_above", "_first", "_last")
