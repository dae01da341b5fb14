"""The training-data operators against brute force, round trips and held-out accuracy, and on awkward tables."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
import zlib
from urllib.parse import urljoin

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeframe.llm import ann, chat_format, decontaminate, language_id, line_dedup, mixing, near_dedup, pii, token_output, topics, url_filter
from latticeframe.llm._shared import connected_components
from latticeframe.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()
AWKWARD = [
    (1, None, "en", "a"), (2, "", None, "b"), (3, " \n\t\n ", "fr", None), (4, "one", "en", "a"), (5, "one", "en", "a"), (None, "a text without an id, long enough to count", "en", "a"),
    (6, "Same line of text here\nother words in this one\nSame line of text here ", "en", "a"), (7, "  SAME LINE OF TEXT HERE\nand its own words", "en", "a"), (7, "  SAME LINE OF TEXT HERE\nand its own words", "en", "a"),
    (8, "wört " * 60_000, "de", "a"), (9, "😀é 12345 \ud83d".encode("utf-8", "ignore").decode(), "es", "c"), (10, "12 34 .. ##", "en", "c"),
]
CLASHES = ("row", "n", "node", "doc", "score", "lang_pred", "tie", "k_draw", "first_doc", "component", "keep", "topic_", "dropped", "rank")


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(texts, width, percent=80):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == sorted(df.columns)
    want = sorted((tuple(r[theirs.index(c)] for c in sorted(theirs)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(theirs)) for r in df.collect()), key=repr) == want


# components and near duplicates


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(300, 300), (None, 3), (5, None)]
    parent = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def variants(seed, groups=6, size=9):
    """Chains of edited copies, so that some pairs fall below the threshold but stay connected."""
    rng = random.Random(seed)
    out, i = {}, 0
    for _ in range(groups):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 120))]
        for _ in range(size):
            out[i] = " ".join(text)
            i += 1
            if rng.random() < 0.8:
                for _ in range(max(1, len(text) // 14)):
                    text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            text = list(text)
    return out


@pytest.mark.parametrize("limit", [4096, 3])
def test_near_duplicates_against_brute_force(spark, limit):
    texts = variants(1) | {1000 + k: t for k, t in enumerate(variants(2, 2, 20).values())}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, width=2, node_limit=limit, cell_rows=limit).collect()}
    assert got == components(texts, 2)


def test_trees_have_their_own_positions():
    sig = np.arange(2 * near_dedup.POSITIONS, dtype=np.uint32).reshape(2, -1)
    sig[1, 16:] = sig[0, 16:]  # only the first 16 positions differ
    a, b = near_dedup.leaves(sig, 12, 4, 0.8)
    assert set(a.tolist()) & set(b.tolist())


@pytest.mark.parametrize("comps", [50, 3])
def test_all_pairs_of_different_components_meet(spark, comps):
    names = ["node", "comp", "doc", "n", *near_dedup.SKETCH]
    comp = {k: k if comps == 50 else max(0, k - 48 + comps - 1) for k in range(50)}  # all their own, or one large one and two rows
    rows = spark.createDataFrame([(7, comp[k], k, 9, *[0] * len(near_dedup.SKETCH)) for k in range(50)] + [(8, 5, k, 9, *[0] * len(near_dedup.SKETCH)) for k in range(60, 70)], ", ".join(f"{c} long" for c in names))
    cells = {}
    for r in near_dedup._in_cells(rows, 4).collect():
        cells.setdefault(r.node, set()).add(r.doc)
    met = {(a, b) for c in cells.values() for a in c for b in c if a < b}
    assert {(a, b) for a in range(50) for b in range(a + 1, 50) if comp[a] != comp[b]} <= met and not any(d >= 60 for c in cells.values() for d in c)
    assert max(map(len, cells.values())) < 30


def test_the_similarity_is_taken_as_it_is(spark):
    words_ = [f"w{k}" for k in range(401)]  # 400 shingles each, 357 in common of 443: .8058
    other = words_[:358] + [f"x{k}" for k in range(43)]
    df = spark.createDataFrame([(1, " ".join(words_)), (2, " ".join(other))], "doc_id long, text string")
    assert [sum(r.kept for r in near_dedup.near_duplicates(df, width=2, similarity=x).collect()) for x in (0.805, 0.8065)] == [1, 2]


def test_near_duplicates_awkward(spark, awkward, empty):
    got = near_dedup.near_duplicates(awkward, width=2).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_shingles, by[1].component_id, by[1].kept) == (0, 1, True) and by[3].n_shingles == 0 and by[2].component_id == 2
    assert (by[4].component_id, by[5].component_id, by[5].kept) == (4, 4, False)
    assert by[None].component_id is None and by[None].kept and by[8].n_shingles == 1
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.drop_near_duplicates(awkward, width=2)
    assert kept.columns == awkward.columns and kept.where("doc_id = 5").isEmpty() and kept.where("doc_id IS NULL").count() == 1


def test_only_the_copies_rows_go(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, text + " more"), (2, "a text of its own that only shares its id"), (None, text), (None, text), (3, text), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("x"))
    got = sorted(((r.doc_id or -1), r.text or "") for r in near_dedup.drop_near_duplicates(df).collect())
    assert got == sorted([(1, text), (2, rows[2][1]), (-1, text), (-1, text), (3, "")])


# language


def direct_kernel(texts):
    """The presence kernel from sets of n-grams of code points, without hashes or matrices."""

    def of(text):
        s = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
        return {s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1)}

    sets = [of(t) for t in texts]
    return np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])


def test_language_against_direct_computation(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL AND length(text) < 4000").orderBy("doc_id").limit(60).collect()
    texts = [re.sub(r"^[^\w]+|[^\w]+$", "", r.text) for r in rows] + ["это текст по-русски", "これは日本語の文です", "이것은 한국어 문장입니다"]
    langs = [r.lang for r in rows] + ["ru", "ja", "ko"]
    model = language_id.fit(list(zip(texts, langs, strict=True)), per_language=100, ridge=1e-3)
    seen = np.zeros(language_id.CODES, bool)
    order = sorted(range(len(texts)), key=lambda k: (texts[k], langs[k]))
    found = [language_id.grams(texts[k], seen) for k in order]
    want = direct_kernel([texts[k] for k in order])
    rng, label = np.random.default_rng(7), np.array([model.languages.index(langs[k]) for k in order])
    chosen = np.concatenate([rng.permutation(np.flatnonzero(label == g))[:100] for g in range(len(model.languages))])
    assert np.abs(language_id._features(found, model) - want[:, chosen]).max() < 0.02  # but for hashes that agree
    # ridge regression, from the kernel itself: minimises weighted squares plus ridge over the landmarks' span
    kernel = language_id._features(found, model).astype(float)
    y = np.where(label[:, None] == np.arange(len(model.languages)), 1.0, -1.0)
    weight = 1 / np.bincount(label)[label]
    value, vector = np.linalg.eigh(kernel[chosen])
    keep = value > 1e-6 * value.max()
    basis = vector[:, keep] / np.sqrt(value[keep])
    x = kernel @ basis
    penalty = 1e-3 * np.trace((x * weight[:, None]).T @ x) / x.shape[1]
    stacked = np.concatenate((x * weight[:, None] ** 0.5, penalty**0.5 * np.eye(x.shape[1])))
    direct = basis @ np.linalg.lstsq(stacked, np.concatenate((y * weight[:, None] ** 0.5, np.zeros((x.shape[1], y.shape[1])))), rcond=None)[0]
    assert np.allclose(kernel @ model.weights, kernel @ direct, atol=1e-3)
    assert language_id.predict(model, ["русский текст", "日本語の文章", "한국어", "1 2 3", None], seen)[0] == ["ru", "ja", "ko", "und", "und"]


def test_users_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "words of one text", "en", 0.123, "mine"), (2, "les mots", "fr", 0.5, None)], "doc_id long, text string, lang string, Score double, lang_pred string")
    got = language_id.identify(docs)
    assert got.columns == ["doc_id", "text", "lang", "Score", "lang_pred", "lang_pred_", "score_"]
    assert sorted((r.doc_id, r.Score, r.lang_pred) for r in got.collect()) == [(1, 0.123, "mine"), (2, 0.5, None)]


def test_language(spark, awkward, empty):
    rows = language_id.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 40 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    got = {r.doc_id: r for r in language_id.identify(awkward).collect()}
    assert [got[k].lang_pred_ for k in (1, 2, 3, 10)] == ["und"] * 4 and got[8].lang_pred_ in ("de", "en", "es", "fr") and all(0 <= r.score_ <= 1 for r in got.values())
    assert {r.lang_pred for r in got.values()} == {r.score for r in got.values()} == {"x"}
    assert language_id.identify(empty).count() == 0
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred_ for r in language_id.identify(unlabelled).collect()} == {"und"}


# lines


def test_lines_awkward(spark, awkward, empty, monkeypatch):
    def texts():
        out = line_dedup.dedup_lines(awkward).select("doc_id", "n_lines", "n_dropped", line_dedup.kept_text(line_dedup.lines_of(F.col("text")), F.col("keep")).alias("kept"))
        return sorted(((r.doc_id or 0, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=repr)

    got = texts()
    assert len(got) == len(AWKWARD)
    assert [g for g in got if g[0] == 7] == [(7, 2, 1, "and its own words")] * 2 and (6, 3, 0, AWKWARD[6][1]) in got
    assert (1, 1, 0, "") in got and (2, 1, 0, "") in got and (3, 3, 0, " \n\t\n ") in got
    assert line_dedup.dedup_lines(empty).count() == 0


def test_hot_lines_are_decided_alike(spark, monkeypatch):
    rows = [(k, f"the common line of all\nline number {k % 700} of them\nown {k}") for k in range(2100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(df).collect()}
    assert got == {k: (k > 0) + (k >= 700) for k in range(2100)}


# chats


def test_chats(spark):
    t = chat_format.Template()
    texts = ["</s>[INST] ok [/INST]", "\\0\\1 <<s>s>", "\\", "", None, "<<SYS>>\\8<s>", "é😀"]
    rows = [(1, 0, "system", texts[1]), (1, 1, "user", texts[0]), (1, 2, "assistant", texts[5]), (2, 0, "user", texts[2]), (2, 1, "user", texts[4]), (3, 5, None, texts[6]), (3, 5, None, texts[6]), (None, 0, "user", "x"), (None, 1, "assistant", texts[6]), (4, 0, "tool", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("n", F.lit(1)).withColumn("piece", F.lit(2))
    chats = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.read_segments(chats).collect()}
    for conv in (1, 2, 3, None, 4):
        want = [((r[2] or ""), (r[3] or "")) for r in rows if r[0] == conv]
        assert [(x["role"], x["text"]) for x in got[conv].turns] == want
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, None: True, 4: False}
    assert got[1].formatted.count("</s>") == 1 and got[1].formatted.count("[INST]") == 1
    assert [x["loss"] for x in got[1].turns] == [False, False, True]
    assert chat_format.format_chats(df.where("false")).count() == 0 and t.loss == ("assistant",)


def test_long_conversations_take_time_in_proportion(spark):
    def seconds(n):
        turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("a turn of some words "), F.col("id").cast("string")).alias("text"))
        began = time.perf_counter()
        row = chat_format.chat_digests(chat_format.format_chats(turns)).first()
        assert row.n_turns == n and row.valid
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 15  # 350 s when each turn walks the whole text
    with pytest.raises(ValueError):
        chat_format.Template(marks={"user": ("<s>", "\n"), "other": ("", "</s>")})


# personal data


def base_spans(t):
    t, out = t or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


HARD = [
    "a@b.c_x@y.z and a@b.c@d.e", "1.2.3.4.5.6.7.8 001.2.3.255 99999999999.1.1.1 0000000.1.1.1", "+1 (234) 567-8901 +12 3", "4111 1111 1111 1111 4111-1111-1111-1111", "x..a@b..c a.@.b.c a@b.c. a@-.-  12", "1 " * 20_000,
    "a." * 20_000 + "@b" + ".c" * 20_000, "+" * 5000 + "+1" + "2 " * 9000, "1" * 50_000, "é😀 a@b.co 😀 +4915112345678", "%a@b.c-@d.e", None, "", " 12 a@bc.d",
]


def test_pii_against_regular_expressions(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").withColumn("found", F.lit(1))
    documents = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit(1).alias("found"))
    texts = dict(enumerate(HARD)) | {r.doc_id: r.text for r in documents.collect()}
    for r in pii.find_pii(df.unionAll(documents)).collect():
        assert [(s.kind, s.start, s.end) for s in r.found if s.kind in pii.BASE] == base_spans(texts[r.doc_id])


def test_pii_checks_and_context(spark):
    assert [[(s.kind, round(s.score, 2)) for s in r.found] for r in pii.find_pii(spark.createDataFrame([(1, "x@mail.com"), (2, "ship 10.0.0.1"), (3, "courriel x@y.fr"), (4, 'API_KEY = "04dbebab91ab85687d33"'), (5, "the token is lost")], "doc_id int, text string")).orderBy("doc_id").collect()] == [
        [("email", 0.9)], [("ip", 0.7)], [("email", 1.0)], [("secret", 0.8)], []]
    df = spark.createDataFrame([(1, "iban GB82 WEST 1234 5698 7654 32"), (2, "GB82WEST12345698765433"), (3, "id 123-45-6789"), (4, "SSN 123-45-6789"), (5, "host 10.0.0.1"), (6, "10.0.0.1")], "doc_id int, text string")
    got = {r.doc_id: [(s.kind, round(s.score, 2)) for s in r.found] for r in pii.find_pii(df).collect()}
    assert got == {1: [("iban", 1.0)], 2: [], 3: [], 4: [("ssn", 0.7)], 5: [("ip", 1.0)], 6: [("ip", 0.7)]}
    assert pii.find_pii(df.where("false")).count() == 0


def test_many_spans_take_time_in_proportion(spark):
    def seconds(n):
        text = " ".join(f"a{k}@b{k}.com" for k in range(n))
        began = time.perf_counter()
        got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found
        assert [(s.kind, s.start, s.end) for s in got] == base_spans(text)
        return time.perf_counter() - began

    seconds(600)
    assert seconds(40_000) < 30  # some 90 s when each span walks the whole text


# benchmark


def edit_distance(pattern, text):
    """Least word edits of the pattern to any stretch of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for t in text:
        new = [0]
        for k, p in enumerate(pattern, 1):
            new.append(min(row[k - 1] + (p != t), row[k] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = []
    norm = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    for k in range(60):
        w = norm(items[rng.choice(list(items))])
        for _ in range(rng.randrange(0, max(1, len(w) // 3))):
            at = rng.randrange(len(w))
            if len(w) > 3:
                w[at : at + 1] = rng.choice([[], [f"zz{k}"], [w[at], f"yy{k}"]])
        text = [f"a{rng.randrange(99)}" for _ in range(20)] + w + [f"b{rng.randrange(99)}" for _ in range(20)]
        docs.append((k, " ".join(text)))
    long = [f"v{rng.randrange(500)}" for _ in range(300)]  # of several segments
    items |= {5000: " ".join(long), 5001: "quite short", 5002: "one four word item"}
    for k in range(12):
        w = list(long)
        for _ in range(60 - k % 2 * 58):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        docs.append((100 + k, " ".join([f"a{rng.randrange(99)}" for _ in range(2000 + 40 * k)] + w)))
    docs += [(200, "This is QUITE, short!"), (201, "quite a short"), (202, "one four word items"), (203, "x one four word item")]
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (None, docs[0][1])], "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([*items.items(), (7777, None), (7778, " ,, ")], "item_id long, text string")
    want = set()
    for d, t in docs:
        for i, item in items.items():
            p = norm(item)
            if edit_distance(p, norm(t)) <= int(0.2 * len(p) + 1e-9):
                want.add((d, i))
    assert len(want) > 30 and {(200, 5001), (203, 5002)} <= want and not {201, 202} & {d for d, _ in want} and sum(i == 5000 for _, i in want) == 12
    got = decontaminate.contaminations(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None} == want
    assert all(r.distance == edit_distance(norm(items[r.item_id]), norm(dict(docs)[r.doc_id])) for r in got if r.doc_id is not None)
    assert decontaminate.contaminations(df.where("false"), bench).count() == 0
    assert decontaminate.contaminations(df, bench.where("false")).count() == 0
    clean = sorted((r.doc_id or -1) for r in decontaminate.drop_contaminated(df, bench).collect())
    none = [] if 0 in {x for x, _ in want} else [-1]  # the row without an id has document 0's text
    assert clean == sorted([d for d, _ in docs if d not in {x for x, _ in want}] + [900, 901] + none)


def test_rows_are_dropped_by_their_text(spark):
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(1, "before " + item), (1, "a clean text of the same id"), (None, item + " after"), (None, "clean and without an id"), (2, item), (2, item), (3, None)]
    bench = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("x"))
    assert sorted(str(r.text) for r in decontaminate.drop_contaminated(df, bench).collect()) == ["None", "a clean text of the same id", "clean and without an id"]
    got = decontaminate.contaminations(df, bench).collect()
    assert len(got) == 9 and {r.distance for r in got} == {0}  # three items, and three different rows


def test_recall_at_the_edge_of_the_edits():
    """Windows at every word against items at exactly the allowed edits; ordinary words, so that few keys agree by chance."""
    rng, walks = random.Random(4), decontaminate.Walks(4, 8, 2)
    for n in (5, 10, 14, 20, 40, 64, 150):
        hit = 0
        for trial in range(120):
            item = [rng.randrange(1, 1 << 60) for _ in range(n)]
            w = list(item)
            for _ in range(decontaminate.allowed(n, 0.8)):
                at, new = rng.randrange(len(w)), rng.randrange(1 << 60)
                w[at : at + 1] = ([new], [], [w[at], new])[trial % 3]
            zeros = [0] * decontaminate.LONGEST
            text, whole = np.array([1, 2, 3, *w, 4, 5, 6, *zeros], np.uint64), np.array([*item, *zeros], np.uint64)
            start, found = np.arange(len(w) + 6), False
            paths = walks.paths(text, start)
            for k, (offset, size) in enumerate(decontaminate.segments(n)):
                begin = np.array([offset])
                own = walks.keys(whole, begin, walks.paths(whole, begin), np.array([0]), size)
                found |= bool((walks.keys(text, start, paths, start, size) == own).any())
            hit += found
        assert hit / 120 >= 0.95, (n, hit)


def test_edit_distance_in_bits():
    rng = random.Random(9)
    for _ in range(300):
        p, t = [rng.randrange(5) for _ in range(rng.randrange(1, 70))], [rng.randrange(5) for _ in range(rng.randrange(0, 90))]
        assert decontaminate.distance(p, t)[0] == edit_distance(p, t)


def test_the_gate_passes_every_window_within_the_edits():
    rng = random.Random(12)
    item = [rng.randrange(1, 1 << 60) for _ in range(30)]
    slots = np.zeros(1 << 10, np.uint64)
    for w in item:
        slots[w & 1023] |= np.uint64(1 << 29)
    gate = decontaminate.Gate(slots, np.zeros(128, np.uint8), [30], 30, 0.8)
    for _ in range(200):
        w = list(item)
        for _ in range(6):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[0x5555], [], [w[at], 0x5555]])
        text = np.array([*w, *[0] * decontaminate.LONGEST], np.uint64)
        assert any(0 in start for _, start in gate.windows(text)) or w[0] == 0x5555


# mixing


def test_raking_meets_targets():
    rng = np.random.default_rng(2)
    table = rng.integers(1, 100, (3, 4, 2)).astype(float)
    targets = [np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.6, 0.4])]
    w = mixing.rake(table, targets)
    for k, t in enumerate(targets):
        assert np.allclose(w.sum(tuple(x for x in range(3) if x != k)), t)


def form():
    return F.when(F.col("text").contains("x"), "x").otherwise("plain")


def brute_rates(rows, targets, budget=None, temper=0.7):
    """Raking by plain loops over dictionaries: rates by cell."""
    cells = {}
    for _, text, lang, source in rows:
        cell = (source, lang, "x" if "x" in text else "plain")
        cells[cell] = cells.get(cell, 0) + len(words(text))
    total, goals = sum(cells.values()), []
    for axis, d in enumerate(("source", "lang", "topic")):
        share = {}
        for c, n in cells.items():
            share[c[axis]] = share.get(c[axis], 0) + n / total
        given = targets.get(d)
        if given is None:
            goal = {c: x**temper for c, x in share.items()}
        else:
            rest = sum(x for c, x in share.items() if c not in given)
            goal = {c: given.get(c, x / rest * (1 - sum(given.values())) if rest else 0) for c, x in share.items()}
        goals.append({c: x / sum(goal.values()) for c, x in goal.items()})
    w = {c: n / total for c, n in cells.items()}
    for _ in range(2000):
        for axis, goal in enumerate(goals):
            now = {}
            for c, x in w.items():
                now[c[axis]] = now.get(c[axis], 0) + x
            w = {c: x * goal[c[axis]] / now[c[axis]] for c, x in w.items()}
    rate = {c: x * total / cells[c] for c, x in w.items()}
    scale = 1 / max(rate.values())
    if budget:
        low, high = 0, 1 / min(rate.values())
        for _ in range(200):
            scale = (low + high) / 2
            low, high = (low, scale) if sum(min(1, rate[c] * scale) * n for c, n in cells.items()) >= budget * total else (scale, high)
    return {c: min(1, x * scale) for c, x in rate.items()}


def drawn(doc_id, seed=20):
    return int(hashlib.md5(f"{doc_id}:{seed}".encode()).hexdigest()[:13], 16) / 2**52


@pytest.mark.parametrize("driver_cells", [1 << 17, 3])
def test_mixing_against_brute_force(spark, driver_cells):
    rng = random.Random(8)
    rows = [(k, "w " * rng.randrange(1, 9) + rng.choice(["", "x"]), rng.choice(["en", "fr", "de"]), f"s{int(rng.random() ** 2 * 5)}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for targets, budget in (({"source": {"s4": 0.3, "s0": 0.2}, "topic": {"x": 0.6}}, None), ({}, 0.4)):
        if driver_cells == 3 and budget:
            continue
        want = brute_rates(rows, targets, budget)
        options = {"targets": targets, "budget": budget, "topic": form(), "driver_cells": driver_cells}
        got = {(r.source, r.lang, r.topic): r.rate for r in mixing.calibrate(docs, **options).collect()}
        assert set(got) == set(want) and all(abs(got[c] - want[c]) < 1e-6 for c in want)
        ids = {i for i, text, lang, source in rows if drawn(i) < want[source, lang, "x" if "x" in text else "plain"]}
        assert {r.doc_id for r in mixing.mix(docs, **options).collect()} == ids


def test_mixing_of_the_query_against_its_rates(spark):
    rows = mixing.op2_mixing(spark, SF).collect()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.n_tokens == len(words(texts[r.doc_id].text)) and (r.lang, r.source) == (texts[r.doc_id].lang, texts[r.doc_id].source) and drawn(r.doc_id) < r.rate + 1e-9 for r in rows)
    assert 0.25 < sum(r.n_tokens for r in rows) / sum(len(words(r.text)) for r in texts.values()) < 0.75


def test_topics_part_texts_by_their_words():
    rng = random.Random(1)
    kinds = [[f"{c}{k}" for k in range(60)] for c in "abc"]
    texts = [" ".join(rng.choice(kinds[k % 3]) for _ in range(40)) for k in range(90)]
    got, n = topics.assign(topics.fit(texts, 3), [*texts, None, " "])
    assert len(set(got[:90])) == 3 and all(len(set(got[k:90:3])) == 1 for k in range(3)) and got[90:] == ["none"] * 2 and n.tolist() == [40] * 90 + [0, 0]
    assert topics.fit([], 3)[1].shape == (1, topics.BUCKETS)


def test_topics_are_fitted_on_every_text(spark, monkeypatch):
    rng = random.Random(2)
    kinds = [[f"{c}{k}" for k in range(12)] for c in "abc"]
    texts = [" ".join(rng.choice(kinds[k % 2]) for _ in range(30)) for k in range(4000)]
    texts += [" ".join(rng.choice(kinds[2]) for _ in range(8000)) for _ in range(4)]  # a kind of few rows, all of them long
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    want = topics.assign(topics.fit(texts[::-1], 3), [*texts, None, ""])
    for rows, parts in ((docs, 64), (docs.repartition(7), 1)):  # merged by the driver, and by tasks first
        monkeypatch.setattr(topics, "PARTS", parts)
        got = rows.select("doc_id", topics.topic_and_tokens(rows, 3).alias("t")).orderBy("doc_id").collect()
        assert [r.t.topic for r in got] == want[0] and [r.t.n for r in got] == want[1].tolist()
    kind = [{r.t.topic for r in some} for some in (got[:4000:2], got[1:4000:2], got[4000:4004])]
    assert all(len(k) == 1 for k in kind) and len(set.union(*kind)) == 3 and want[0][-2:] == ["none"] * 2


def test_mixing(spark, awkward, empty):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7), ["en", "fr"][k % 2], ["a", "a", "b"][k % 3]) for k in range(6000)], "doc_id long, text string, lang string, source string")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "fr": 0.4}}
    out = mixing.mix(docs, targets=targets).withColumn("t", mixing.token_count(F.col("text")))
    total = out.agg(F.sum("t")).first()[0]
    share = lambda c: {r[0]: r[1] / total for r in out.groupBy(c).agg(F.sum("t")).collect()}
    assert abs(share("source")["a"] - 0.5) < 0.03 and abs(share("lang")["en"] - 0.6) < 0.03
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in mixing.mix(docs.repartition(5), targets=targets).collect())
    kept = mixing.mix(awkward, budget=1.0, most=1)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)
    assert mixing.mix(empty).count() == 0


def test_markers_are_no_categories(spark):
    rows = [(1, "a b", "en", "?"), (2, "a b", "en", None), (3, "a b", "en", "*"), (4, "a", "en", "=s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.calibrate(docs, targets={"source": {"?": 0.5}}, topic=F.lit("t")).collect()
    assert {r.source: r.tokens for r in got} == {"?": 2, None: 2, "*": 2, "=s": 1} and abs(sum(r.weight for r in got if r.source == "?") - 0.5) < 1e-9


def test_targets_that_cannot_be_met_are_errors(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, "a b", "fr", "t")], "doc_id long, text string, lang string, source string")
    with pytest.raises(ValueError):  # each source has its language, so shares are the same
        mixing.calibrate(docs, targets={"source": {"s": 0.9}, "lang": {"en": 0.2}}, topic=F.lit("t"))


def test_mixing_meets_targets_of_rare_sources(spark):
    rows = [(k, "w " * (1 + k % 5), ["en", "fr"][k // 80 % 2], f"s{min(k % 80, 70)}") for k in range(12000)]  # 71 sources
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {f"s{k}": 0.01 for k in range(60)} | {"s5": 0.1, "s64": 0.05}}
    for options in ({}, {"most": 3}):
        share = {}
        for r in mixing.calibrate(docs, targets=targets, topic=F.lit("t"), **options).collect():
            share[r.source] = share.get(r.source, 0) + r.weight
        assert all(abs(share[s] - x) < 1e-6 for s, x in targets["source"].items())
        assert (len(share) == 71) == (not options)
    drawn_ = mixing.mix(docs, targets=targets).withColumn("n", mixing.token_count(F.col("text"))).groupBy("source").agg(F.sum("n").alias("n")).collect()
    assert abs(sum(r.n for r in drawn_ if r.source == "s5") / sum(r.n for r in drawn_) - 0.1) < 0.03
    with pytest.raises(ValueError):
        mixing.mix(docs, targets={"source": {"nowhere": 0.1}})


# tokens


def test_elias_fano():
    rng = np.random.default_rng(4)
    for values in ([0], [0, 0, 0], [0, 5], np.sort(rng.integers(0, 10**6, 3000)), np.cumsum(rng.integers(0, 3, 2000)), [0, 1 << 40]):
        ef = token_output.EliasFano.encode(np.array(values))
        assert ef.all().tolist() == list(map(int, values)) == [ef.select(k) for k in range(len(values))]
    dense = np.arange(0, 4 * 10**5, 400)
    ef = token_output.EliasFano.encode(dense)
    assert (len(ef.low) + len(ef.high) + 4 * len(ef.samples)) * 8 / len(dense) < 12


def test_tokens_round_trip(spark, awkward, empty):
    path = token_output.word_tokenizer()
    whole = token_output.Encoder(path, pieces=False)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = token_output.tokens_round_trip(docs, path, pieces=True, shard_tokens=5000).orderBy("doc_id").collect()
    start = 0
    for r, g in zip(docs.orderBy("doc_id").collect(), got, strict=True):
        ids = np.append(whole.encode(r.text), 2).astype("<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    odd = token_output.tokens_round_trip(awkward, path, pieces=True).orderBy("start").collect()
    assert [r.doc_id for r in odd] == sorted([r[0] for r in AWKWARD], key=lambda x: -1 if x is None else x) and {r.n_tokens for r in odd if r.doc_id in (1, 2, 3)} == {1}
    assert token_output.tokens_round_trip(empty, path).count() == 0


def test_shards_are_read_by_select(tmp_path):
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 40, 700)
    ids = rng.integers(0, 49000, lengths.sum())
    (tmp_path / "x.lftok").write_bytes(token_output.pack_shard(np.arange(700), lengths, ids, 49408))
    ends = np.cumsum(lengths)
    with open(tmp_path / "x.lftok", "rb") as f:
        shard = token_output.Shard(f)
        assert not hasattr(shard, "offsets")
        for (doc, start, got), end, n in zip(shard.documents(), ends, lengths, strict=True):
            assert start == end - n and got.tolist() == ids[end - n : end].tolist()
            assert doc == np.searchsorted(ends, end, "left") or n == 0


def test_what_the_encoder_remembers_stays_within_its_bytes():
    rng = random.Random(6)
    e = token_output.Encoder(token_output.word_tokenizer(), pieces=True, budget=1 << 23)
    assert e.pieces
    for _ in range(300):  # a corpus without spaces
        text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(400))
        assert e.encode(text).tolist() == e._whole(text)
    assert e.memory() < 1 << 16
    for k in range(60):  # and one of ever new words
        e.encode(" ".join(f"w{rng.randrange(10**9)}" for _ in range(2000)))
        assert e.memory() <= 1 << 23


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    other = public_tokenizers.path("byte_bpe_50k.json")
    assert token_output.cuts_at_spaces(token_output.word_tokenizer()) and not token_output.cuts_at_spaces(other)
    e = token_output.Encoder(other, pieces=True)
    assert not e.pieces and e.encode("a b  c").tolist() == e._whole("a b  c")


def test_pieces_give_the_librarys_ids():
    e = token_output.Encoder(token_output.word_tokenizer(), pieces=True, budget=3)
    for t in ("a <|endoftext|> b<|startoftext|>c", "A <|ENDOFTEXT|>, x", "It's  we'll x\x1cy\n\n 12,5", "é ́ ÉTÉ, é, É. ΣΣ Σ", "a, b. c.\nd., e,. f,", ",", " , a,", "a,\xa0b"):
        assert e.encode(t).tolist() == e._whole(t)


def test_pieces_are_cut_as_a_pattern_cuts_them():
    rng = random.Random(8)
    texts = ["", "a", ".", "a.", "'s", *("".join(rng.choice("ab'.,-\\`~{@ \n1éZ\t") for _ in range(rng.randrange(60))) for _ in range(3000))]
    e = token_output.Encoder(token_output.word_tokenizer(), pieces=True)
    for t in texts:
        data = t.encode().translate(token_output._PLAIN)
        assert token_output.cut(data) == re.sub(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])", b" ", t.encode().lower()).replace(b"\n", b" ").split(b" ")
        assert e.encode(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


# urls


def test_urls(spark):
    pages = [
        (1, "http://a.example.org/es/1", '<link rel="canonical" href="http://b.net/x">'), (2, "http://b.net/x?q=1", None), (3, "http://c.net/y#f", "<META http-equiv='refresh' content='0; URL=http://B.net/x'>"),
        (4, "http://www.foo.com/fr/1", "<link href=/fr/2 rel=canonical>"), (5, "http://www.foo.com/fr/2", '<link href="http://c.net/y" rel="canonical">'), (6, None, "x"), (7, "junk", None), (8, "HTTP://Z.com", None),
        (9, "https://d.net/", ""), (9, "https://d.net/", ""), (10, "http://EXAMPLE.org/en/12", None), (11, "http://notexample.org/es/1", None), (12, "http://x.com/de", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("fit", F.lit(1)).withColumn("component", F.lit("x"))
    redirects = spark.createDataFrame([("https://d.net/", "http://e.net/"), ("http://e.net/", "http://u.de.com/de/1"), (None, "http://e.net/")], "src string, dst string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, redirects=redirects).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2][2:] == (None, "block") and got[3][3] == "block"
    assert got[5][2:] == ("com/fr/", "allow") and got[6] == got[7] == ("", "", None, "allow") and got[8] == ("z.com", "", None, "allow")
    assert got[9][3] == "block" and got[10][2:] == ("example.org/en/1", "block") and got[11][2:] == ("org/", "allow") and got[12][2] is None
    assert url_filter.filter_urls(df).count() == len(pages) and url_filter.filter_urls(df.where("false")).count() == 0


def test_links_against_the_standard_library(spark):
    rng = random.Random(2)
    parts = ["a", "b.html", "..", ".", "c"]  # no empty segments: the standard library drops those
    bases = ["http://h.com", "https://h.com/d/e/f.html?q=/x", "http://h.com/d/", "http://h.com/p#frag"]
    links = ["/".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "/"]) for _ in range(60)] + ["?id=1", "x?y=/../z", "/a#b", "//o.org/p/q?r", "http://o.org", "https://o.org/a/b?c"]
    pages, want = [], {}
    for k, (base, link) in enumerate((b, x) for b in bases for x in links):
        quote = rng.choice(['"', "'"])
        rel = rng.choice(["canonical", "Canonical nofollow", "x canonical"])
        tag = rng.choice([f"<link data-href=/no rel={quote}{rel}{quote} href={quote}{link}{quote}>", f"<LINK title={quote}a > b href=/no{quote} HREF={quote} {link} {quote} rel={quote}{rel}{quote} />"])
        pages.append((k, base, f"<html><link rel=stylesheet href=/canonical.css>{tag}<meta name=canonical content=refresh>"))
        whole = urljoin(base, link).split("#")[0].split("?")[0]
        want[k] = None if link == "" else whole
    edges = url_filter.alias_edges(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("url", F.concat("url", F.lit("")))).where("dst IS NOT NULL")
    got = sorted((r.src, r.dst) for r in edges.collect())
    assert got == sorted((pages[k][1], w) for k, w in want.items() if w is not None)


def test_long_pages_and_entities(spark):
    html = "x" * 2_000_000 + "<meta http-equiv=Refresh content=\"5; url=&#39;/y?a=1&amp;b=2&#39;\">"
    pages = spark.createDataFrame([(1, "http://a.com/x", html), (2, "http://b.com/x", '<link rel="canonical" href="http:&#x2F;&#x2F;example.org/es/1">')], "page_id long, url string, html string")
    assert sorted((r.src, r.dst) for r in url_filter.alias_edges(pages).collect()) == [("http://a.com/x", "http://a.com/y"), ("http://b.com/x", "http://example.org/es/1")]
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages).collect()} == {1: "allow", 2: "block"}


# vectors


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[100:1500] = x[100]  # a large group of copies
    rows = [(k, v.tolist(), "x") for k, v in enumerate(x)] + [(5000, None, "x"), (5020, [0.0] * 32, "x"), (5040, [float("nan")] * 32, "x"), (5061, [1.0], "x"), (None, [1.0] * 32, "x")]
    df = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"))
    assert df.count() == 3001
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), sample_rows=1000).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q, found in got.items():
        found.sort()
        score = ann.exact_scores(x[q], x)
        want = [k for k in np.lexsort((np.arange(3000), -score)) if k != q][:20]
        ids = [f[1] for f in found]
        hit, total = hit + len(set(ids) & set(want)), total + 20
        assert [f[0] for f in found] == list(range(1, 21)) and [f[2] for f in found] == [score[k] for k in ids]
        if q in (100, 120):
            assert ids == want
    assert len(got) == 150 and hit / total >= 0.95
    few = ann.search(df.where("vec_id < 5"), df.where("vec_id = 0"))
    assert few.count() == 4 and ann.search(df.where("false"), df.where("false")).count() == 0


def test_vectors_of_other_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [2.0, 1.0]), (20, [1.0, 1.0, 1.0]), (3, [3.0, 0.0, 0.0]), (0, [0.0, 1.0]), (4, [-0.0, 1.0]), (5, [0.0, 1.0])]
    df = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id % 20 = 0"), k=4).collect())
    assert [g for g in got if g[0] == 20] == [(20, 1, 3, 3.0)]
    assert [g for g in got if g[0] == 0] == [(0, 1, 2, 2.0), (0, 2, 2, 1.0), (0, 3, 4, 1.0), (0, 4, 5, 1.0)]  # of both its vectors together


def scan_recall(x, query_ids, k=20, rerank=400):
    """Recall, by query, of the best ``rerank`` of all rows by their codes; queries are rows of ``x``."""
    sample = x[np.random.default_rng(0).permutation(len(x))[:4000]].astype(np.float64)
    book = ann.fit((sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32))
    code, factor = ann.coded(book, x)
    assert (ann.unpack(ann.pack(code), len(book.centres)) == code).all()
    near, out = ann.scan(x[query_ids], code, book.centres, factor), []
    for row, q in zip(near, query_ids, strict=True):
        score = ann.exact_scores(x[q], x)
        score[q], row[q] = -np.inf, -np.inf
        out.append(len(set(np.argsort(-score)[:k]) & set(np.argsort(-row)[:rerank])) / k)
    return np.array(out)


@pytest.mark.parametrize("norms", ["even", "uneven"])
def test_recall_where_few_rows_are_scored(norms):
    """60,000 rows, of which 400 (0.7 %) are scored exactly."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60_000, 32)) * (np.exp(rng.normal(size=(60_000, 1))) if norms == "uneven" else 1)
    assert scan_recall(x.astype(np.float32), np.arange(0, 60_000, 1000)).mean() >= 0.95


def test_copies_shut_no_nearer_rows_out(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x[:2000] = x[0]  # a third of all rows
    x[2000:2200] = x[0] + 0.6 * rng.normal(size=(200, 32))  # near the copied vector, some nearer to the queries than it
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = {}
    for r in ann.search(df, df.where("vec_id BETWEEN 2000 AND 2199"), rerank=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    recall = []
    for q, ids in got.items():
        score = ann.exact_scores(x[q], x)
        recall.append(len(set(ids) & set([i for i in np.lexsort((np.arange(6000), -score)) if i != q][:20])) / 20)
    assert len(recall) == 200 and np.mean(recall) >= 0.99 and min(recall) >= 0.9


def test_search_misses_nothing_on_uneven_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 33)) * np.where(rng.random((6000, 1)) < 0.002, 1000, 1)  # a few very long rows
    x[1000:4000] = x[rng.integers(0, 5, 3000)] + 1e-4 * rng.normal(size=(3000, 33))  # and clusters that a code can't tell apart
    x[0:30] = rng.normal(size=(30, 33))
    x = x.astype(np.float32)
    rows = [(0 if k < 30 else k, v) for k, v in enumerate(x.tolist())]  # thirty rows of one id, none a candidate of its queries
    df = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = ann.search(df, df.where("vec_id % 60 = 0")).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    ids = np.array([r[0] for r in rows])
    for q in range(60, 6000, 60):
        score = ann.exact_scores(x[q], x)
        order = np.lexsort((ids, -score))
        assert got[q] == [ids[k] for k in order if k != q][:20]
    assert len(got) == 100 and 0 not in got[0] and len(got[0]) == 20


# the pipeline


def test_unlabelled_documents_pass_the_first_stage(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "words of a text", None), (2, "12 34", None), (3, None, None), (4, "слово", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == [1, 4]


def test_mixing_weighs_by_the_language_that_is_told(spark):
    import corpus_pipeline

    rng = random.Random(4)
    kinds = {"en": "the of and to in is that for it with as was on are this".split(), "fr": "le la les des et est une dans que pour qui sur pas vous nous".split()}
    right = [["en", "fr"][k % 2] for k in range(600)]
    labels = [None if k % 50 < 2 else right[k - 1] if k % 50 < 4 else right[k] for k in range(600)]  # some missing, some wrong
    rows = [(k, " ".join(rng.choice(kinds[right[k]]) for _ in range(30)), labels[k], "s") for k in range(600)]
    rows.append((600, "今日は天気がいい " * 3000, "ja", "s"))  # too long to be learned from
    docs = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), SF)
    assert [r.lang for r in docs.orderBy("doc_id").collect()] == [*right, "ja"]
    tokens = {r.lang: r.tokens for r in mixing.calibrate(docs, topic=F.lit("t")).collect()}
    assert tokens == {"en": 9000, "fr": 9000, "ja": 3000}


def test_pipeline_keeps_users_columns(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("score", F.lit(0.123)).withColumn("lang_pred", F.concat(F.lit("u"), "doc_id")).withColumn("told", F.lit(1)).withColumn("doc", F.lit(2))
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before
        rows = docs.collect()
        assert rows and all(r.score == 0.123 and r.lang_pred == f"u{r.doc_id}" and r.told == 1 and r.doc == 2 for r in rows)


def test_pipeline(spark, tmp_path, awkward):
    import corpus_pipeline

    ids = [r.doc_id for r in corpus_pipeline.run(spark, SF).collect()]
    assert len(set(ids)) == len(ids) and 0 < len(ids) < 200
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        kept = {r.doc_id for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near_dedup":  # a brute-force version on five-word shingles
            assert kept == {i for i, (_, c) in components(texts, 5).items() if i == c and any(map(str.isalpha, texts[i]))}
    assert set(ids) <= kept
    for folder, rows in ((str(tmp_path / "sf"), awkward), (str(tmp_path / "none"), awkward.where("false"))):
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        n = corpus_pipeline.run(spark, folder).count()
        assert n > 0 if folder.endswith("sf") else n == 0
