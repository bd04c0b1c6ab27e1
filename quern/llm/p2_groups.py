"""Problem 2: splits that keep related records together.

Method: random-mate contraction. Records that name the same author, source or entity are joined by an edge to the least
record of that name. Each round every vertex flips a coin (a hash of vertex and round); each tail with a head beside it
collapses into the least such head, edges are relabelled by joins and loops vanish. When no edge is left, the recorded
mates are unwound by pointer doubling, and whole components go to splits by cumulative weight.

Every table of a round is written to shared storage, so lost executors cost no more than their tasks. Hubs are salted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.plans.shared import HOT_SHARE, attach_by_key, discard, materialize, materialize_counted

_NOT_ALNUM = re.compile(r"[\W_]+")

# Names of metadata keys by what they name (letters and digits, casefolded).
META_KEYS = {
    "author": ("author", "authors", "byline", "contributor", "contributors", "creator", "postedby", "poster", "writer", "writtenby"),
    "source": ("source", "sources", "origin", "url", "uri", "link", "ref", "refs", "references", "takenfrom"),
    "entity": ("entity", "entities", "about", "topic", "topics", "subject", "theme"),
}
# Labels that begin a line of its own, by what they name.
LABELS = {
    "author": ("author", "written by", "posted by", "contributed by", "autor", "autora", "escrito por", "publicado por", "verfasst von", "geschrieben von", "verfasser", "글쓴이", "작성자", "지은이", "投稿者", "作者", "著者", "筆者"),
    "source": ("source", "taken from", "origin", "fuente", "tomado de", "quelle", "entnommen aus", "출처", "出典", "引用元"),
    "entity": ("topic", "about", "subject", "tema", "asunto", "thema", "주제", "話題", "主題"),
}
# Values that name nobody or nothing.
FILLERS = {
    "", "anonymous", "anon", "general", "misc", "miscellaneous", "na", "nil", "none", "null", "nobody", "nothing", "other", "tbd", "unknown", "unnamed", "various",
    "anonimo", "anónimo", "desconocido", "ninguno", "varios", "unbekannt", "anonym", "keine", "keiner", "verschiedenes", "allgemein", "익명", "없음", "미상", "일반", "匿名", "不明", "なし", "一般",
}

_TYPE_OF_KEY = {k: t for t, keys in META_KEYS.items() for k in keys}
_LINE = re.compile(
    r"^[\s>*•\-–﻿​]*(?:(" + "|".join(re.escape(x) for t in LABELS for x in sorted(LABELS[t], key=len, reverse=True)) + r")\s*(?:[:：]\s*|\s+)|\[\[)\s*(.+?)\s*$",
    re.IGNORECASE,
)
_TYPE_OF_LABEL = {x: t for t, labels in LABELS.items() for x in labels}


def normal(kind: str, value: str) -> str | None:
    """One spelling of a name: its letters and digits; of a source, those of site and item. None if it names nothing."""
    text = value.casefold().strip()
    if _NOT_ALNUM.sub("", text) in FILLERS:  # of any kind: a filler may look like a site and an item ("n/a")
        return None
    if kind == "source":
        text = re.sub(r"^[a-z][a-z0-9+.\-]*://", "", text)
        text = re.sub(r"^www\.", "", text)
        text = re.split(r"[?#]", text)[0]
        site, _, item = text.partition("/")
        site = re.sub(r"\.example\s*$", "", site)
        site, item = _NOT_ALNUM.sub("", site), _NOT_ALNUM.sub("", item)
        return f"{site}/{item}" if site and item else None
    return _NOT_ALNUM.sub("", text)


def names_in_meta(value: object, kind: str | None = None) -> Iterator[tuple[str, str]]:
    """Names below keys that stand for an author, source or entity, at any depth and in lists."""
    if isinstance(value, dict):
        for k, v in value.items():
            own = _TYPE_OF_KEY.get(_NOT_ALNUM.sub("", str(k).casefold()))
            yield from names_in_meta(v, own)
    elif isinstance(value, list):
        for v in value:
            yield from names_in_meta(v, kind)
    elif kind and isinstance(value, (str, int)) and not isinstance(value, bool):
        yield kind, str(value)


def names_in_text(text: str) -> Iterator[tuple[str, str, bool]]:
    """Names on labelled or bracketed lines of their own, and whether the line's form alone makes them names.

    A colon, brackets, a single word after an author's label and a site with an item after a source's label do. Any other
    line that begins with a label ("About the harbor ...") may be a sentence; what follows is a name only if the same name
    stands somewhere in a form that is certain.
    """
    for line in text.splitlines():
        m = _LINE.match(line)
        if not m:
            continue
        if m[1] is None:
            if m[2].endswith("]]"):
                yield "entity", m[2][:-2], True
            continue
        kind = _TYPE_OF_LABEL[m[1].casefold()]
        certain = bool(re.match(r"\s*[:：]", line[m.end(1) :]))
        certain = certain or kind == "author" and len(m[2].split()) == 1 or kind == "source" and "/" in m[2] and " " not in m[2].replace(" / ", "/")
        yield kind, m[2], certain


def record_names(df: DataFrame, id_col: str, meta_col: str, text_col: str) -> DataFrame:
    """``id, name, certain``: distinct normalised names of every record, prefixed by kind."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("certain", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, sure = [], [], []
            for i, meta, text in zip(*(c.to_pylist() for c in batch.columns)):
                found: dict[str, bool] = {}
                try:
                    pairs = [(k, v, True) for k, v in names_in_meta(json.loads(meta))] if meta else []
                except (ValueError, RecursionError):
                    pairs = []
                for kind, value, certain in (*pairs, *names_in_text(text or "")):
                    name = normal(kind, value)
                    if name:
                        found[f"{kind}:{name}"] = found.get(f"{kind}:{name}", False) or certain
                ids += [i] * len(found)
                names += found.keys()
                sure += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(sure, pa.bool_())], schema.fieldNames())

    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), meta_col, text_col)
    return rows.mapInArrow(run, schema)


def relabel(rows: DataFrame, column: str, labels: DataFrame, degree: str, total: int, most: int) -> DataFrame:
    """Replace ``column`` by its label, where it has one. ``labels``: ``v, label`` and its degree, ``most`` at most.

    Labels of hubs (at most 2 / HOT_SHARE, as degrees add up to twice the edges) are broadcast and their rows kept out of
    the shuffle's hot partition; all others are joined on the vertex. Without a hub the join is all there is.
    """
    least = max(1000, int(total * HOT_SHARE))
    others = [c for c in rows.columns if c != column]
    rest = labels.filter(F.col(degree) < least).select(F.col("v").alias("_v"), F.col("label").alias("_label"))
    if most < least:
        return rows.join(rest, F.col(column) == F.col("_v"), "left").select(*others, F.coalesce("_label", column).alias(column))
    hubs = F.broadcast(labels.filter(F.col(degree) >= least).select(F.col("v").alias("_hub"), F.col("label").alias("_hub_label")))
    out = rows.join(hubs, F.col(column) == F.col("_hub"), "left")
    spread = F.when(F.col("_hub").isNotNull(), F.struct(F.lit(1).alias("h"), F.xxhash64(*rows.columns).alias("v"))).otherwise(F.struct(F.lit(0).alias("h"), F.col(column).alias("v")))
    out = out.withColumn("_at", spread).join(rest.withColumn("_at", F.struct(F.lit(0).alias("h"), F.col("_v").alias("v"))), "_at", "left")
    return out.select(*others, F.coalesce("_hub_label", "_label", column).alias(column))


def head(v: str, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), F.col(v)), F.lit(2)) == 1


def components(edges: DataFrame) -> DataFrame:
    """``v, root`` of every vertex of an edge list ``u, v`` (longs), by random-mate contraction. Loops are ignored.

    A round is two writes: the mates, and the edges between what is left. Both report their size as they are written.
    """
    of_edges = lambda df: df.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now, left = materialize_counted(of_edges(edges), "p2-edges")
    mates: list[DataFrame] = []
    turn = 0
    while left["rows"]:
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mate = F.min(F.when(~head("u", turn) & head("v", turn), F.col("v")))
        picked = both.groupBy("u").agg(mate.alias("label"), F.count("*").alias("degree")).withColumnRenamed("u", "v")
        picked, seen = materialize_counted(picked.filter("label is not null"), "p2-mates", F.max("degree").alias("degree"))
        if not seen["rows"]:  # all coins fell alike
            continue
        mates.append(picked)
        moved = relabel(relabel(now, "u", picked, "degree", left["rows"], seen["degree"]), "v", picked, "degree", left["rows"], seen["degree"])
        after, left = materialize_counted(of_edges(moved), "p2-edges")
        discard(now)
        now = after
    if not mates:
        return now.select("v", F.col("u").alias("root"))
    # Unwind: every vertex but the roots collapsed exactly once, so the mates form a forest of depth <= turns.
    forest = mates[0].select("v", "label")
    for m in mates[1:]:
        forest = forest.unionByName(m.select("v", "label"))
    forest, size = materialize_counted(forest, "p2-forest")
    depth = 1
    while depth < len(mates):
        children = forest.groupBy(F.col("label").alias("c")).agg(F.count("*").alias("degree"))
        labels, seen = materialize_counted(forest.join(children, F.col("v") == F.col("c")).select("v", "label", "degree"), "p2-labels", F.max("degree").alias("degree"))
        if not seen["rows"]:  # no label is itself a vertex: all point to roots
            break
        further = materialize(relabel(forest, "label", labels, "degree", size["rows"], seen["degree"]), "p2-forest")
        discard(forest)
        discard(labels)
        forest, depth = further, depth * 2
    for m in mates:
        discard(m)
    return forest.select("v", F.col("label").alias("root"))


def groups(df: DataFrame, id_col: str = "sample_id", meta_col: str = "meta", text_col: str = "text") -> DataFrame:
    """``group_id, sample_id, n`` for every record of a group of two or more; ``group_id`` is the group's least id.

    Defined cases: null or broken ``meta`` and null texts name nothing; filler values name nothing; null ids are left out;
    repeated rows of one id count once; an empty table gives no groups; other columns are not carried, so names cannot
    clash. Texts are read whole, and a record may name any number of authors, sources and entities.
    """
    named, size = materialize_counted(record_names(df, id_col, meta_col, text_col).select("id", F.xxhash64("name").alias("key"), "certain"), "p2-names")
    total = max(size["rows"], 1)
    facts = named.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.max("certain").alias("name")).filter("n > 1 and name")
    edges = attach_by_key(named, facts, "key", "id", "n", total).select(F.col("id").alias("u"), F.col("least").alias("v"))
    rooted = components(edges)
    # The root itself is no row of the forest; every member, roots included, under the least id of its group.
    sizes = rooted.groupBy("root").agg(F.least(F.min("v"), F.first("root")).alias("group_id"), (F.count("*") + 1).alias("n"))
    sizes = materialize(sizes, "p2-sizes")
    members = attach_by_key(rooted.select(F.col("v").alias("sample_id"), "root"), sizes, "root", "sample_id", "n", total)
    roots = sizes.select("group_id", F.col("root").alias("sample_id"), "n")
    return members.select("group_id", "sample_id", "n").unionByName(roots)


def found(df: DataFrame) -> DataFrame:
    return groups(df).select("group_id", "sample_id")


def splits(df: DataFrame, id_col: str = "sample_id", meta_col: str = "meta", text_col: str = "text", shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("valid", 0.1), ("test", 0.1))) -> DataFrame:
    """``sample_id, group_id, split``: every record assigned, groups whole, shares of rows as near as possible.

    Groups of at least a thousandth of all rows (at most a thousand) are placed first, largest first, where most room is
    left. All others follow in hash order by cumulative weight: sums of hash buckets give each bucket's offset, a window
    inside the bucket the rest. A single record is a group of its own.
    """
    grouped = materialize(groups(df, id_col, meta_col, text_col), "p2-groups")
    every = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("sample_id")).distinct()
    member = grouped.select("sample_id", "group_id", F.col("n").alias("weight"))
    placed = every.join(member, "sample_id", "left").select("sample_id", F.coalesce("group_id", "sample_id").alias("group_id"), F.coalesce("weight", F.lit(1)).alias("weight"))
    placed = materialize(placed, "p2-placed")
    total = placed.count()
    if not total:
        return placed.select("sample_id", "group_id", F.lit(None).cast("string").alias("split"))
    room = {name: share * total for name, share in shares}
    least = max(2, int(total * HOT_SHARE))
    large = placed.filter((F.col("weight") >= least) & (F.col("sample_id") == F.col("group_id"))).select("group_id", "weight").collect()
    assigned = []
    for r in sorted(large, key=lambda r: (-r["weight"], r["group_id"])):
        name = max(room, key=lambda k: room[k])
        room[name] -= r["weight"]
        assigned.append((r["group_id"], name))
    spark = df.sparkSession
    of_large = F.broadcast(spark.createDataFrame(assigned, "group_id long, fixed string"))
    # Small groups: one row each, ordered by hash.
    small = placed.filter((F.col("weight") < least) & (F.col("sample_id") == F.col("group_id"))).select("group_id", "weight")
    buckets = max(16, min(65536, total // 2000))
    order = F.xxhash64(F.lit("order"), F.col("group_id"))
    small = small.withColumn("order", order).withColumn("bucket", F.pmod(F.shiftright(F.col("order"), 40), F.lit(buckets)).cast("int"))
    sums = {r["bucket"]: r["s"] for r in small.groupBy("bucket").agg(F.sum("weight").alias("s")).collect()}  # at most 65,536 rows
    offset, upto = [], 0
    for b in range(buckets):
        offset.append((b, upto))
        upto += sums.get(b, 0)
    positive = {k: max(v, 0.0) for k, v in room.items()}
    scale = upto / (sum(positive.values()) or 1.0)
    edge, cases, names = 0.0, None, [n for n, _ in shares]
    at = F.col("before") + F.col("within") - F.col("weight") / 2
    for name in names[:-1]:
        edge += positive[name] * scale
        cases = F.when(at < edge, name) if cases is None else cases.when(at < edge, name)
    within = F.sum("weight").over(Window.partitionBy("bucket").orderBy("order", "group_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = (
        small.join(F.broadcast(spark.createDataFrame(offset, "bucket int, before long")), "bucket")
        .withColumn("within", within)
        .select("group_id", (cases.otherwise(names[-1]) if cases is not None else F.lit(names[-1])).alias("free"))
    )
    out = placed.join(of_large, "group_id", "left").join(chosen, "group_id", "left")
    return out.select("sample_id", "group_id", F.coalesce("fixed", "free").alias("split"))


__all__ = ["components", "found", "groups", "record_names", "splits"]
