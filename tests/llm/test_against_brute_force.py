"""Operators against plain versions on the smallest tables."""

import itertools
import json
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import p2_groups, p4_overlap, p5_pack, p6_collapse, p7_encode, p8_leak, p9_split
from quern.llm.kernels import common_in_order
from quern.llm.p1_patterns import Names, detect
from quern.llm.p1_surrogates import draw, lexicon, render

WORDS = re.compile(r"[^\W_]+")


@pytest.fixture(scope="module")
def samples(spark, sf):
    return spark.read.parquet(f"{sf}/text_samples.parquet")


@pytest.fixture(scope="module")
def rows(samples):
    return samples.select("sample_id", "split_name", "text", "meta").collect()


def plain_names(meta, text):
    """Names of a record by the rule as stated, without the operator's code."""
    kinds = {"author": "author|posted_by|contributors", "source": "source|url|origin|refs", "entity": "entity|about|entities"}
    labels = {
        "author": ("author", "written by", "posted by", "escrito por", "verfasst von", "작성자", "autor", "글쓴이", "投稿者", "作者"),
        "source": ("source", "fuente", "quelle", "출처", "出典", "taken from"),
        "entity": ("topic", "tema", "thema", "주제", "話題"),
    }
    nobody = ("", "na", "none", "null", "unknown", "anonymous", "general", "nil", "tbd", "misc", "various", "other")
    values = []
    stack = [("", json.loads(meta or "null"))]
    while stack:
        key, v = stack.pop()
        if isinstance(v, dict):
            stack += v.items()
        elif isinstance(v, list):
            stack += [(key, x) for x in v]
        elif isinstance(v, str):
            values += [(k, v) for k, ks in kinds.items() if key.lower() in ks.split("|")]
    for line in (text or "").splitlines():
        line = line.strip()
        if line.startswith("[[") and line.endswith("]]"):
            values.append(("entity", line.strip("[]")))
        for kind, heads in labels.items():
            for h in heads:
                rest = line[len(h) :].strip()
                if line.lower().startswith(h) and (rest[:1] in (":", "：") or h in ("written by", "posted by", "escrito por", "verfasst von", "작성자") and len(rest.split()) == 1 or " from" in h and "/" in rest and " " not in rest.replace(" / ", "/")):
                    values.append((kind, rest.lstrip(":： ")))
    for kind, v in values:
        v = v.casefold()
        letters = "".join(c for c in v if c.isalnum())
        if letters in nobody:
            continue
        if kind == "source":
            v = v.split("?")[0].split("://")[-1].removeprefix("www.")
            site, _, item = v.partition("/")
            letters = "/".join("".join(c for c in x if c.isalnum()) for x in (site.strip().removesuffix(".example"), item))
        yield kind, letters


def test_groups(samples, rows, spark):
    rows = [*rows]
    big = spark.read.parquet("/root/testdata/sf0.01/text_samples.parquet").select("sample_id", "split_name", "text", "meta")
    for df, given_rows in ((samples, rows), (big, big.collect())):
        parent = {r.sample_id: r.sample_id for r in given_rows}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        first = {}
        for r in given_rows:
            for name in plain_names(r.meta, r.text):
                a, b = root(first.setdefault(name, r.sample_id)), root(r.sample_id)
                parent[max(a, b)] = min(a, b)
        groups = defaultdict(set)
        for x in parent:
            groups[root(x)].add(x)
        want = {(min(g), x) for g in groups.values() if len(g) > 1 for x in g}
        assert {(r.group_id, r.sample_id) for r in p2_groups.found(df).collect()} == want
        assert max(map(len, groups.values())) * 20 < len(given_rows)  # no filler fuses the table
    split = p2_groups.splits(samples).collect()
    assert len(split) == len(rows)
    assert all(len({r.split for r in split if r.group_id == g}) == 1 for g in {r.group_id for r in split})


def test_names_of_lines(spark):
    text = "Written by Ana Maria Ruiz\nAbout the harbor we said nothing\nSource: n/a\nAuthor: N/A\nTopic: " + "long " * 60 + "name"
    found = {n: c for _, n, c in p2_groups.record_names(spark.createDataFrame([(1, None, text)], "i long, m string, t string"), "i", "m", "t").collect()}
    assert found == {"author:anamariaruiz": False, "entity:theharborwesaidnothing": False, "entity:" + "long" * 60 + "name": True}
    pair = [(1, None, "Written by Ana Maria Ruiz"), (2, '{"author": "ana maria ruiz"}', None), (3, None, "About the harbor"), (4, None, "About the harbor")]
    out = p2_groups.found(spark.createDataFrame(pair, "sample_id long, meta string, text string")).collect()
    assert {tuple(r) for r in out} == {(1, 1), (1, 2)}


def test_contraction_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 90)] + [(5, 5)]
    out = p2_groups.components(spark.createDataFrame(edges, "u long, v long")).collect()
    by_root = defaultdict(set)
    for r in out:
        by_root[r.root].add(r.v)
    assert sorted(sorted(vs | {k}) for k, vs in by_root.items()) == [list(range(61)), list(range(1000, 1090))]


def units(text):
    words = WORDS.findall(text.casefold())
    letters = "".join(words)
    kana = sum("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in letters)
    return list(letters) if letters and kana * 2 >= len(letters) else words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def key(text):
    f = p6_collapse.fields_of(text)
    return ("f", *f) if f else ("s", p6_collapse.bare(text))


def test_overlaps(samples, rows):
    have = [(r.sample_id, r.split_name, units(r.text), r.text) for r in rows if r.text and r.split_name and units(r.text)]
    want = set()
    for i, s, u, t in have:
        for j, q, v, w in have:
            if s == "train" and q != "train":
                n = max(len(u), len(v))
                near = min(len(u), len(v)) >= 0.8 * n and len(set(u) & set(v)) > 3 and lcs(u, v) >= 0.8 * n
                if near or key(t) == key(w) or p6_collapse.bare(t) == p6_collapse.bare(w):
                    want.add((min(i, j), max(i, j)))
    assert {(r.sample_a, r.sample_b) for r in p4_overlap.found(samples).collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_common_in_order(a, b):
    assert common_in_order(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) == lcs(a, b)


def test_collapse(samples, rows):
    keep = {}
    want = set()
    for r in sorted(rows, key=lambda r: r.sample_id):
        if r.text and p6_collapse.bare(r.text):
            k = key(r.text)
            if k in keep:
                want.add((keep[k], r.sample_id))
            keep.setdefault(k, r.sample_id)
    assert {(r.keep_id, r.copy_id) for r in p6_collapse.found(samples).collect()} == want


def test_fields_in_any_order():
    a, b = '{"a": "x y", "b": 2}', "B : 2.\nA: X-Y"
    assert p6_collapse.fields_of(a) == p6_collapse.fields_of(b)
    assert p6_collapse.fields_of('{"a": 2, "b": "x y"}') != p6_collapse.fields_of(a)
    assert p6_collapse.fields_of("one line: only") is None


def reference_encoding():
    import tiktoken

    e = p7_encode.Encoder()
    ranks = {b: i for i, b in enumerate(e.bytes_of) if b}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return e, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(spark, sf):
    e, want = reference_encoding()
    rnd = random.Random(3)
    alphabet = list("asStTrReEvVlLdDmM'''   \n\t\r1２3.,!?—한が字é　 ​😀")
    fuzz = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    ids, at, _ = e.encode(fuzz)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [want.encode_ordinary(t) for t in fuzz]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in p7_encode.encode_corpus(docs, "doc_id", "text").collect()}
    for r in docs.select("doc_id", "text").collect():
        assert got[r.doc_id] == want.encode_ordinary(r.text or "")
        assert e.decode(got[r.doc_id]) == (r.text or "")


def test_offsets_cut_the_text_at_tokens(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    e = p7_encode.Encoder()
    for r in p7_encode.encode_corpus(docs, "doc_id", "text", with_offsets=True).collect():
        assert [text[r.doc_id][a:b] for a, b in zip([0, *r.ends], r.ends)] == [e.bytes_of[i] for i in r.ids]


def test_pieces(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    e, want = reference_encoding()
    pieces = defaultdict(list)
    for r in p9_split.split_oversized(docs, "doc_id", "text").collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == {i for i, t in text.items() if len(want.encode_ordinary(t)) > 512}
    for i, ps in pieces.items():
        ps.sort(key=lambda r: r.piece_no)
        raw = text[i].encode()
        assert ps[0].start_byte == 0 and ps[-1].end_byte == len(raw)
        for p in ps:
            assert raw[p.start_byte : p.end_byte].decode() == p.piece and len(want.encode_ordinary(p.piece)) <= 512
        for p, q in itertools.pairwise(ps):
            assert 16 <= len(want.encode_ordinary(raw[q.start_byte : p.end_byte].decode())) <= 64


def test_leaks(spark, sf):
    docs, given_items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    grams = defaultdict(set)
    for r in given_items.collect():
        for t in (r.passage or "", r.question or ""):
            w = WORDS.findall(t.casefold())
            s = "".join(w)
            for k in range(len(s) - 24 if r.lang == "ja" else len(w) - 9):
                grams[s[k : k + 25] if r.lang == "ja" else tuple(w[k : k + 10])].add(r.item_id)
    want = set()
    for r in docs.collect():
        w = WORDS.findall((r.text or "").casefold())
        s = "".join(w)
        for g in itertools.chain((tuple(w[k : k + 10]) for k in range(len(w) - 9)), (s[k : k + 25] for k in range(len(s) - 24))):
            want |= {(r.doc_id, i) for i in grams.get(g, ())}
    got = p8_leak.leaks(docs, "doc_id", "text", given_items, "item_id", "lang", ["passage", "question"])
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    clean = p8_leak.without_spans(docs, "doc_id", "text", given_items, "item_id", "lang", ["passage", "question"])
    rows_ = {r.doc_id: r for r in clean.collect()}
    assert {(i, x) for i, r in rows_.items() for x in r["items"]} == want
    assert len(rows_) == docs.count()
    for r in docs.collect():
        new = rows_[r.doc_id]
        assert (new.clean_text == r.text) == (new.removed == 0)
    again = p8_leak.leaks(clean.select("doc_id", "clean_text"), "doc_id", "clean_text", given_items, "item_id", "lang", ["passage", "question"])
    assert again.count() == 0


def test_leaks_in_several_blocks_and_spans(spark, monkeypatch):
    passage = "Straße one two three four five six seven eight nine ten eleven"
    given_items = spark.createDataFrame([(k, "en", f"{passage} {k}", "か" * 10 + str(k) + "き" * 20) for k in range(7)] + [(9, "JA", "か" * 10 + "3" + "き" * 20, None)], "item_id long, lang string, passage string, question string")
    text = "ẞ before, STRASSE one; two three four five six seven eight nine ten! after"
    docs = spark.createDataFrame([(1, text), (1, "other"), (2, "x" + "か" * 10 + "3・" + "き" * 20 + "y"), (None, text), (3, None)], "doc_id long, text string")
    args = (docs, "doc_id", "text", given_items, "item_id", "lang", ["passage", "question"])
    whole = sorted(map(tuple, p8_leak.scan(*args).drop("text_key").collect()))
    assert [(d, i, text[a:b]) for d, i, a, b in whole if d == 1] == [(1, k, "STRASSE one; two three four five six seven eight nine ten") for k in range(7)]
    assert [r for r in whole if r[0] == 2] == [(2, 9, 1, 33)]
    monkeypatch.setattr(p8_leak, "BLOCK_CHARS", 100)
    assert sorted(map(tuple, p8_leak.scan(*args).drop("text_key").collect())) == whole
    clean = sorted((r.doc_id or 0, r.clean_text or "", r.removed) for r in p8_leak.without_spans(*args).collect())
    assert clean == sorted([(0, text, 0), (1, "other", 0), (1, "ẞ before,  ! after", 57), (2, "x y", 32), (3, "", 0)])


def test_size_of_a_large_block():
    rng = random.Random(3)
    words = ["".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(9000)]
    parts = [(k, " ".join(rng.choice(words) for _ in range(80))) for k in range(20_000)]
    ngrams = p8_leak.NgramSet(parts, False)
    assert len(ngrams.hashes) == 20_000 * 71
    assert sum(x.nbytes for x in (ngrams.hashes, ngrams.part, ngrams.first, ngrams.letters, ngrams.at, ngrams.bits)) < 200e6


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 300), max_size=60))
def test_plan_places_every_item_once(histogram):
    plan = p5_pack.make_plan(histogram)
    ranks = defaultdict(int)
    for length, first, count, _, _ in zip(*plan.arrays()):
        assert first == ranks[length]
        ranks[int(length)] += int(count)
    fill = np.zeros(plan.rows, dtype=np.int64)
    for length, count, base, offset in zip(plan.length, plan.count, plan.base, plan.offset):
        assert (fill[base : base + count] == offset).all()
        fill[base : base + count] += length
    assert dict(ranks) == histogram
    assert (fill <= 2048).all() and (not plan.rows or fill.min() > 0)


def test_plan_is_tight():
    rnd = random.Random(1)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[min(2048, max(1, int(rnd.lognormvariate(4.8, 1.2))))] += 1
    tokens = sum(k * v for k, v in histogram.items())
    assert p5_pack.make_plan(dict(histogram)).rows <= 1.005 * tokens / 2048 + 1


NAMES = Names([("Brennvik", "family", "latin"), ("Tovan", "given", "latin"), ("Hazel", "given", "latin"), ("돗", "family", "hangul"), ("누람", "given", "hangul"), ("霧沢", "family", "han"), ("紬音", "given", "han")])


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Write to a.b+c@mail.example or d (at) post (dot) example.", ["email", "email"]),
        ("Call +1 522 555 0101 ext. 12, 01.99.00.20 93 or ０９００３５８２７３９.", ["phone", "phone", "phone"]),
        ("SSN 666-84-1704, 주민번호: 671009-3519044, マイナンバーは5283-0198-8937", ["id_number"] * 3),
        ("passport no. QX8030215 by mistake. DNI 98.109.708-J. Ausweisnummer L85J01141 deutlich.", ["id_number"] * 3),
        ("Meet at 239 Sallowfen St, Apt 29 at five. C/ Corvane, n.º 235. Wendmoorstr. 27a.", ["address"] * 3),
        ("주소: 누람시 별샘길 42번길 6. 住所：雪籠区星凪町4丁目14-12", ["address"] * 2),
        ("Tovan Brennvik signed the list. My name is Ixa Zorbell. TEACHER: BRENNVIK, TOVAN", ["person_name"] * 3),
        ("담당자는 돗누람입니다. 霧沢 紬音様より", ["person_name"] * 2),
        ("笹波様より０９０－０２５１－２８７７ にかけて。전화는01012345678", ["phone"] * 2),
        ("8丁目4番2号霧沢千羽里さんに渡してください。", ["person_name"]),
        ("Score 555-12. Version 3.23.5, build 00181958. It costs 25,255,000 marks. Run 20311125063121 on 2031-04-16.", []),
        ("The Amber Canal Museum opens on Hazel Day. Ask @tobu_kind on the board. Source: kite-forum/2026-07035", []),
        ("Die Straße war um 28 Uhr leer. La calle estaba llena a las 24 horas. room 18-23-18", []),
    ],
)
def test_detection(text, kinds):
    assert [s.kind for s in detect(text, NAMES)] == kinds


def test_surrogates_keep_format_and_coreference(spark):
    one, two = detect("Tovan Brennvik", NAMES)[0], detect("BRENNVIK, TOVAN", NAMES)[0]
    assert one.norm == two.norm
    core = draw("k", one.kind, one.norm, 0)
    a, b = render(one.kind, core, "Tovan Brennvik"), render(two.kind, core, "BRENNVIK, TOVAN")
    assert sorted(a.casefold().split()) == sorted(b.casefold().replace(",", "").split()) and b.isupper() and "," in b
    number = detect("+1 522 555 0101 ext. 12", NAMES)[0]
    phone = render("phone", draw("k", "phone", number.norm, 0), "+1 522 555 0101 ext. 12")
    assert re.fullmatch(r"\+1 52\d \d{3} \d{4} ext\. \d+", phone)
    # Small spaces force collisions; all replacements still differ and none is a real entity.
    found = spark.createDataFrame([("id_number", str(n)) for n in range(10, 50)], "kind string, norm string")
    words = lexicon(found, "k").collect()
    assert len({r.core for r in words}) == 40 and not {r.core for r in words} & {str(n) for n in range(10, 50)}


def test_surrogates_grow_until_all_differ(spark):
    """All two-digit numbers and a third of the addresses of one short form: more than there is room for."""
    given_ = [("id_number", f"{n:02d}") for n in range(100)] + [("address", f"{n} a st") for n in range(1, 10)] + [("phone", f"0101234{n:04d}") for n in range(3000)]
    words = lexicon(spark.createDataFrame(given_, "kind string, norm string"), "k").collect()
    assert len(words) == len(given_) == len({(r.kind, r.core) for r in words})
    assert not {(r.kind, r.core) for r in words} & set(given_)


def test_one_person_and_one_number_in_several_forms():
    text = "Frau Rona Velt called; R. Velt left +82 10-1234-5678. VELT, RONA is at 010 1234 5678 and Rona K. Velt is not."
    found = {text[s.start : s.end]: s for s in detect(text, Names([("Velt", "family", "latin"), ("Rona", "given", "latin")]))}
    assert found["Rona Velt"].norm == found["VELT, RONA"].norm and found["Rona Velt"].gender == "f"
    assert found["+82 10-1234-5678"].norm == found["010 1234 5678"].norm == "01012345678"
    core = draw("k", "phone", "01012345678", 0)
    assert render("phone", core, "010 1234 5678") == f"{core[:3]} {core[3:7]} {core[7:]}"
    assert render("phone", core, "+82 10-1234-5678") == f"+82 {core[1:3]}-{core[3:7]}-{core[7:]}"
    text = "Rona Velt signed, and then R. Velt came."
    spans = detect(text, Names([("Velt", "family", "latin")]))
    assert {s.norm for s in spans} == {"rona velt"}
    core = draw("k", "person_name", "rona velt", 0, "f")
    first, last = core.split()
    assert first.endswith("a") and draw("k", "person_name", "rona velt", 0, "m").split()[0].endswith("o")
    assert render("person_name", core, "R. Velt") == f"{first[0].upper()}. {last.capitalize()}"
    assert render("person_name", draw("k", "person_name", "rona k velt", 0), "Velt, R.").count(",") == 1


def test_addresses_keep_their_parts():
    core = draw("k", "address", "霧沢市鈴掛1丁目15番13号", 0)
    assert re.fullmatch(r"..市..\d丁目\d\d番\d\d号", core) and core != "霧沢市鈴掛1丁目15番13号"
    assert re.fullmatch(r"..시 ..로 \d{3} \d{3}동 \d{4}호", draw("k", "address", "햇솔시 담솔로 153 107동 8944호", 0))
