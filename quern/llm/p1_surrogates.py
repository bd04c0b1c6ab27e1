"""Problem 1: personal information in free text, replaced by typed placeholders and by keyed surrogates.

Method: surrogate generation. Every detected entity gets a replacement drawn by a keyed hash of its normal form, so all
mentions of one entity, however written, get the same replacement (coreference), in the mention's own script and format.
Replacements are drawn once per distinct entity in a lexicon table; a collision check finds entities of one type that drew
the same replacement, or one that is itself a real entity, and draws again until all are distinct. Each further attempt
draws from more forms (fewer kept digits, then longer ones), so that the draw always comes to an end. Names keep script,
token count, order, initials, and the gender that a title before any mention states, or else the ending of the given name;
resident numbers keep the digit that states gender; telephone numbers keep calling codes and trunk prefixes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.p1_patterns import ADDRESS, CALLING, EMAIL, ID_NUMBER, PERSON, PHONE, Names, calling_code, detect, plain
from quern.llm.kernels import strings
from quern.plans.shared import attach_by_key, materialize, materialize_counted

KINDS = (EMAIL, PHONE, ID_NUMBER, ADDRESS, PERSON)
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
#: The list of known name parts is broadcast; a longer list is refused rather than cut.
MOST_NAMES = 1_000_000
#: Setting that holds the key; without it replacements are stable but not secret.
KEY_SETTING = "quern.surrogate.key"

# Words of addresses that stay, as they state the kind of street.
STREET_WORDS = {
    "st", "street", "ave", "avenue", "terrace", "close", "road", "rd", "lane", "ln", "drive", "court", "crescent", "boulevard", "blvd", "square", "row", "gardens", "way", "place", "apt", "flat", "unit",
    "suite", "calle", "c", "avenida", "plaza", "paseo", "camino", "carrera", "ronda", "n", "º", "º b", "b",
}
_STREET_ENDS = ("straße", "strasse", "str", "weg", "gasse", "platz", "allee", "번길", "길", "로", "시", "군", "구", "동", "호")
_HANGUL = "가나다라마바사아자차카하고노도로모보소오조초코호구누두루무부수우주추쿠후기니디리미비시이지치키히"
_HAN = "青山川原木森田野村中北南東西高松竹梅石岩水島林池橋谷本上下内外大小長広安和平明正光春秋夏冬雪月星花"
# Letters that name the parts of an address in Japanese and Korean.
ADDRESS_PARTS = "都道府県市区郡町村丁目番地号の시군구읍면동호"
_ONSETS, _VOWELS = "bdfgklmnprstvz", "aeiou"


class Stream:
    """Endless keyed choices for one entity and attempt."""

    def __init__(self, key: str, kind: str, norm: str, attempt: int):
        self.seed = f"{kind}\x1f{norm}\x1f{attempt}".encode()
        self.key = key.encode()[:64]
        self.pool: list[int] = []
        self.block = 0

    def below(self, n: int) -> int:
        if len(self.pool) < 2:
            digest = hashlib.blake2b(self.seed + self.block.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.pool = list(digest)
            self.block += 1
        return (self.pool.pop() << 8 | self.pool.pop()) % n

    def word(self, length: int) -> str:
        return "".join((_ONSETS if i % 2 == 0 else _VOWELS)[self.below(14 if i % 2 == 0 else 5)] for i in range(max(1, length)))

    def like(self, token: str, keep: str = "") -> str:
        """A token of the same length and script; letters in ``keep`` stay unless they come first."""
        out = []
        for i, c in enumerate(token):
            if i and c in keep:
                out.append(c)
            elif c.isdigit():
                out.append(str(self.below(9) + (1 if i == 0 else 0)))
            elif "가" <= c <= "힣":
                out.append(_HANGUL[self.below(len(_HANGUL))])
            elif "一" <= c <= "鿿" or "぀" <= c <= "ヿ":
                out.append(_HAN[self.below(len(_HAN))])
            else:
                out.append((_ONSETS if i % 2 == 0 else _VOWELS)[self.below(14 if i % 2 == 0 else 5)])
        return "".join(out)


def draw(key: str, kind: str, norm: str, attempt: int, gender: str | None = None) -> str:
    """Replacement of an entity's normal form; same tokens, lengths and scripts, so that any mention can be formatted.

    From the fourth attempt on one token grows (of numbers, after fewer digits are kept from attempt to attempt).
    """
    s = Stream(key, kind, norm, attempt)
    grow = attempt // 4
    longer = lambda token: token + token[-1:] * grow
    if kind == EMAIL:
        local, _, domain = norm.partition("@")
        new = re.sub(r"[a-z]+", lambda m: s.word(len(m[0]) + grow), re.sub(r"\d", lambda m: str(s.below(10)), local))
        return f"{new}{s.word(grow) if grow and not re.search('[a-z]', local) else ''}@" + ".".join(["example", ("com", "net", "org")[s.below(3)]])
    more = "".join(str(s.below(10)) for _ in range(max(0, grow - 3)))
    if kind == PHONE:
        keep = max(int(norm.startswith("0")), (4 if len(norm) > 10 else 3) - grow)
        return norm[:keep] + "".join(str(s.below(10)) for _ in norm[keep:]) + more
    if kind == ID_NUMBER:
        if len(norm) == 13 and norm.isdigit():
            return f"{s.below(100):02d}{1 + s.below(12):02d}{1 + s.below(28):02d}{norm[6]}" + "".join(str(s.below(10)) for _ in range(6)) + more
        return "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in norm) + more
    out = []
    if kind == ADDRESS:
        for token in norm.split():
            end = next((e for e in _STREET_ENDS if token.endswith(e) and len(token) > len(e)), "")
            free = token[: len(token) - len(end)]
            first = all(t in STREET_WORDS for t in out)
            out.append(token if token in STREET_WORDS else s.like(longer(free) if first else free, ADDRESS_PARTS if attempt < 8 else "") + end)
        return " ".join(out)
    tokens = norm.split()
    for k, token in enumerate(tokens):
        new = s.like(longer(token) if k == len(tokens) - 1 else token)
        if k == 0 and len(tokens) > 1 and len(token) > 1 and token.isascii():
            ending = {"f": "a", "m": "o"}.get(gender or "") or (token[-1] if token[-1] in "ao" else "")
            new = new[: len(new) - len(ending)] + ending
        out.append(new)
    return " ".join(out)


def _cased(new: str, old: str) -> str:
    if old.isupper() and len(old) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def render(kind: str, core: str, surface: str) -> str:
    """The replacement in the format of one mention."""
    if kind == EMAIL:
        out = core
        at = re.search(r"\s*(?:@|[(\[{<]\s?\w+\s?[)\]}>]|\sat\s)\s*", surface)
        if at and "@" not in at[0]:
            out = out.replace(".", " (dot) ").replace("@", " (at) ")
        elif at:
            out = out.replace("@", at[0])
        return out.upper() if surface.isupper() else out
    if kind in (PHONE, ID_NUMBER):
        head = ""
        if kind == PHONE:
            digits = re.sub(r"\D", "", plain(surface))
            head = calling_code(plain(surface), digits)
            if head and CALLING[head] and not digits[len(head) :].startswith("0"):
                core = core[1:]
        feed = iter(head + core)
        out = []
        last = 0
        for c in surface:
            if c.isalnum() and (kind == ID_NUMBER or c.isdigit()):
                n = next(feed, None)
                last = len(out) + 1 if n else last
                n = n or ("0" if c.isdigit() else c)
                n = n.lower() if c.islower() else n
                out.append(chr(ord(n) + 0xFEE0) if "０" <= c <= "９" else n)
            else:
                out.append(c)
        return "".join([*out[:last], *feed, *out[last:]])
    tokens = core.split()
    written = re.findall(r"[^\W_]+", surface)
    if kind == PERSON:
        before = len(re.findall(r"[^\W_]+", surface.split(",")[0])) if "," in surface else 0
        if len(written) < len(tokens):  # a mention without the middle names
            tokens = [*tokens[: len(written) - 1], tokens[-1]]
        tokens = tokens[-before:] + tokens[:-before] if before else tokens
        tokens = [t[0] if len(w) == 1 and w.isascii() else t for t, w in zip(tokens, written)]
    feed2 = iter(tokens)
    return re.sub(r"[^\W_]+", lambda m: _cased(next(feed2, m[0]), m[0]), surface)


def name_list(spark: SparkSession, names: DataFrame | None) -> list[tuple]:
    if names is None:
        return []
    rows = names.select("name_text", "name_kind", "script").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"the list of name parts has more than {MOST_NAMES} rows")
    return [tuple(r) for r in rows]


def mentions(df: DataFrame, table: str, id_col: str, text_col: str, known: list[tuple]) -> DataFrame:
    """``src_table, rec_id, kind, norm, start, end, gender``: all personal information in whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(known)
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                out += [(i, s.kind, s.norm, s.start, s.end, s.gender) for s in detect(text, names)]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array([table] * len(out), pa.string()), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())))],
                ["src_table", "rec_id", "kind", "norm", "start", "end", "gender"],
            )

    rows = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col)
    return rows.mapInArrow(run, "src_table string, rec_id long, kind string, norm string, start int, end int, gender string")


_ENTRY = "kind string, norm string, gender string, n long, attempt int, core string"


def lexicon(found: DataFrame, key: str) -> DataFrame:
    """``kind, norm, n, core``: one replacement per distinct entity, different from all others and from every real entity.

    Each round settles the entities whose draw is free, the least of several that drew alike among them; only the rest is
    drawn again, from a space that grows with every attempt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores = [draw(key, k, v, a, g) for k, v, g, a in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cores, pa.string())], ["kind", "norm", "gender", "n", "attempt", "core"])

    one = F.when(F.min("gender") == F.max("gender"), F.min("gender")).alias("gender")  # titles that differ state nothing
    gender = "gender" if "gender" in found.columns else F.lit(None).cast("string").alias("gender")
    todo = found.select("kind", "norm", gender).groupBy("kind", "norm").agg(one, F.count("*").alias("n")).withColumn("attempt", F.lit(0))
    real: DataFrame | None = None
    settled: list[DataFrame] = []
    while True:
        drawn, size = materialize_counted(todo.mapInArrow(run, _ENTRY), "p1-drawn")
        if not size["rows"]:
            return reduce(DataFrame.unionByName, settled or [drawn]).select("kind", "norm", "n", "core")
        real = drawn.select("kind", F.col("norm").alias("core")) if real is None else real
        least = drawn.groupBy("kind", "core").agg(F.min(F.struct("norm", "gender", "n", "attempt")).alias("e")).select("kind", "e.*", "core")
        # Inner joins with what is there already: of a late, small round only the small side moves.
        taken = reduce(DataFrame.unionByName, [least.join(x.select("kind", "core"), ["kind", "core"]).select("kind", "core") for x in (real, *settled)])
        free = materialize(least.join(taken.distinct(), ["kind", "core"], "left_anti").select("kind", "norm", "gender", "n", "attempt", "core"), "p1-settled")
        settled.append(free)
        todo = drawn.join(free.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm", "gender", "n", (F.col("attempt") + 1).alias("attempt"))


def replacements(sources: list[tuple[DataFrame, str, str, str]], names: DataFrame | None = None) -> DataFrame:
    """All mentions with their replacement. ``sources``: (table, its name, id column, text column).

    Defined cases: null ids and null or empty texts have no mentions; other columns are not carried, so names cannot
    clash; repeated rows have their mentions each; overlapping candidates are settled in a fixed order of types; an empty
    table gives an empty table; very long texts are read whole.
    """
    spark = sources[0][0].sparkSession
    key = spark.conf.get(KEY_SETTING, "quern")
    known = name_list(spark, names)
    found = mentions(*sources[0], known)
    for s in sources[1:]:
        found = found.unionByName(mentions(*s, known))
    found, size = materialize_counted(found, "p1-mentions")
    entity = F.struct(F.xxhash64("kind", "norm").alias("a"), F.xxhash64("norm", "kind").alias("b")).alias("entity")
    words = lexicon(found, key).select(entity, "n", "core")
    found = found.select("*", entity)
    total = max(size["rows"], 1)
    # The salt has to vary within one entity, which start and record do.
    keyed = found.withColumn("mention", F.xxhash64("src_table", "rec_id", "start"))
    return attach_by_key(keyed, words, "entity", "mention", "n", total).drop("mention", "n")


def found(sources: list[tuple[DataFrame, str, str, str]], names: DataFrame | None = None) -> DataFrame:
    """``src_table, rec_id, pii_type``: one row for each type replaced in a record."""
    replaced = replacements(sources, names).filter(F.col("core").isNotNull())
    return replaced.select("src_table", "rec_id", F.col("kind").alias("pii_type")).distinct()


def rewrite(df: DataFrame, table: str, id_col: str, text_col: str, replaced: DataFrame) -> DataFrame:
    """``src_table, rec_id, placeholder_text, surrogate_text`` of every record; the rest of a text stays as it is."""
    spans = replaced.filter(F.col("src_table") == table).groupBy("rec_id").agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind", "core"))).alias("spans"))
    rows = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).alias("text")).join(spans, "rec_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked, replaced_ = [], []
            for text, given in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text is None or not given:
                    masked.append(text)
                    replaced_.append(text)
                    continue
                a, b, at = [], [], 0
                for s in given:
                    keep, old = text[at : s["start"]], text[s["start"] : s["end"]]
                    a += [keep, PLACEHOLDER[s["kind"]]]
                    b += [keep, render(s["kind"], s["core"], old)]
                    at = s["end"]
                masked.append("".join([*a, text[at:]]))
                replaced_.append("".join([*b, text[at:]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([table] * batch.num_rows, pa.string()), batch.column(0), pa.array(masked, pa.string()), pa.array(replaced_, pa.string())],
                ["src_table", "rec_id", "placeholder_text", "surrogate_text"],
            )

    return rows.select("rec_id", "text", "spans").mapInArrow(run, "src_table string, rec_id long, placeholder_text string, surrogate_text string")


def anonymized(sources: list[tuple[DataFrame, str, str, str]], names: DataFrame | None = None) -> DataFrame:
    replaced = materialize(replacements(sources, names), "p1-replaced")
    out = [rewrite(*s, replaced) for s in sources]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
