"""The training-data operators against brute force, exact round trips, held-out accuracy and
their DuckDB twins, and their edge cases: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns."""

import hashlib
import io
import random
import re
import struct
import textwrap
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from annualis.llm import op02_factorization_toxicity as tox
from annualis.llm import op04_ftrl_language as lang
from annualis.llm.common import written
from annualis.llm.components import connected_components
from annualis.llm.op01_preferences import answer_swaps, format_preferences
from annualis.llm.op03_nearest_url_diff import extract_main_text, read_lines, shared_lines
from annualis.llm.op05_cgk_decontaminate import ItemIndex, find_leaks, normalise, smallest_distance, without_leaks
from annualis.llm.op06_pca_tiles import cosine_components
from annualis.llm.op07_zip_warc import central_directory, pack_archive, range_read, stored_start, write_archives, read_archives
from annualis.llm.op08_probminhash import Counted, near_duplicates, probability_jaccard, signatures
from annualis.llm.op09_licence_rules import RULES, SENTENCES, scan_licences
from annualis.llm.op10_ac_viterbi import MODEL, SPACE, UNKNOWN, Codec, Pieces, encode_documents
from annualis.sources.tables import TABLES
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, id string"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or ""), "x", "y") for i, t in enumerate(texts)], DOC)


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


POOL = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in ("", "r", "st", "n")]


@pytest.mark.parametrize("name", ["op1_preferences", "op7_zip_warc", "op9_licence_rules"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    got = cur.fetchall()
    assert rows and sorted(cols) == sorted(df.columns) and len(got) == len(rows)
    assert digest(df.columns, rows)[0] == digest(cols, got)[0]


# --- 1 -------------------------------------------------------------------------------------


def test_preferences_prefix_and_masks(spark):
    turn = "array<struct<role:string,text:string>>"
    rows = [(1, [("user", "hi"), ("assistant", "a"), ("user", "more"), ("assistant", "good")],
             [("user", "hi"), ("assistant", "a"), ("user", "more"), ("assistant", "bad")], 0),
            (2, [("user", "x")], [("user", "x")], 0), (3, None, [("assistant", "z")], 0), (4, [("user", "p")], [("user", "p"), ("assistant", "q")], 0)]
    df = spark.createDataFrame(rows, f"pair_id long, chosen {turn}, rejected {turn}, prompt int")
    got = {r.pair_id: r for r in format_preferences(df).collect()}
    a = got[1]
    assert a.prompt_turns == 3 and a.prompt.endswith("<|user|>\nmore<|end|>\n") and a.prompt.count("<|") == 6
    assert a.chosen == "<|assistant|>\ngood<|end|>\n" and [a.chosen[s.start:s.end] for s in a.chosen_mask] == ["good<|end|>\n"]
    assert [a.rejected[s.start:s.end] for s in a.rejected_mask] == ["bad<|end|>\n"]
    assert (got[2].prompt_turns, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", [])
    assert (got[3].prompt, got[3].chosen) == ("", "") and got[3].rejected_mask
    assert got[4].chosen == "" and got[4].rejected.startswith("<|assistant|>")


def test_answer_swaps_handles_nulls_repeats_and_lone_conversations(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 1, "assistant", "a0"), (0, 2, "user", "thanks"), (1, 0, None, "q1"),
            (1, 1, "assistant", "a1"), (None, 0, "user", "lost"), (4, 0, "assistant", "alone"), (6, 0, "user", "no answer")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int").drop("turns")
    got = {r.pair_id: r for r in answer_swaps(df).collect()}
    assert set(got) == {0, 1, 4}  # the next answered conversation, after the last the first
    assert [tuple(t) for t in got[0].chosen] == [("user", "q"), ("assistant", "a0")]
    assert [tuple(t) for t in got[0].rejected] == [("user", "q"), ("assistant", "a1")]
    assert [tuple(t) for t in got[1].rejected] == [("user", "q1"), ("assistant", "alone")]
    assert [tuple(t) for t in got[4].rejected] == [("assistant", "a0")]
    assert got[1].chosen[0].role == "user"
    assert answer_swaps(df.limit(0)).count() == 0 and answer_swaps(df.where("conv_id = 4")).count() == 0


def test_pairs_depart_at_several_turns_with_several_trained_turns(spark):
    df = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}") for c in range(40) for t in range(2 * (1 + c % 4))],
                               "conv_id long, turn long, role string, text string")
    got = format_preferences(answer_swaps(df)).collect()
    assert len(got) == 40 and {r.prompt_turns for r in got} == {1, 3, 5, 7}
    assert {len(r.chosen_mask) for r in got} == {1, 2, 3, 4} and any(len(r.chosen_mask) != len(r.rejected_mask) for r in got)


# --- 2 and 4 -------------------------------------------------------------------------------


def test_machine_learns_a_pair_of_terms():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = map(int, rng.random(2) < 0.5)
        noise = rng.integers(100, 160, 6)
        rows.append(np.unique(np.concatenate([noise, [1] * a, [2] * b])).astype(np.uint32))
        y.append(float(a and b))
    m = tox.fit(rows, np.array(y))
    i, j = (int(np.searchsorted(m.terms, t)) for t in (1, 2))
    assert m.v[i] @ m.v[j] > 0.5  # more than the sum of both

    def z(*t):
        r = [int(np.searchsorted(m.terms, x)) for x in t]
        s = m.v[r].sum(axis=0)
        return m.bias + m.w[r].sum() + 0.5 * (s @ s - (m.v[r] ** 2).sum())

    assert z(1, 2) > 0 > max(z(1), z(2))


def test_toxicity_held_out_and_edges(spark):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(800):
        bad = rng.random() < 0.25
        t = words(rng, rng.randint(5, 80), POOL).split()
        if bad:
            t[rng.randrange(len(t))] = rng.choice(["zwillo", "krampu"]) + rng.choice(["", "ig", "ung", "est"])
        texts.append(" ".join(t))
        labels.append((i, 1, int(bad)))
    docs, lab = docs_of(spark, [*texts, None, "", "zwillo " * 50_000]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = tox.train(docs, lab)
    got = {r.doc_id: r for r in tox.score_documents(docs, m).collect()}
    assert len(got) == 803 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    right = [got[i].predicted == y for i, _, y in labels if got[i].held_out]
    assert np.mean(right) > 0.95 and got[800].predicted == got[801].predicted == 0 and got[802].predicted == 1
    assert tox.without_toxic(docs, m).columns == docs.columns
    empty = tox.train(docs.limit(0), lab.limit(0))
    assert tox.score_documents(docs.limit(0), empty).count() == 0 and tox.score_documents(docs.limit(3), empty).count() == 3


def test_language_held_out_and_edges(spark):
    rows = [(r.doc_id, r.lang, r.held_out, r.lang_pred, r.score) for r in E.queries()["op4_ftrl_language"](spark, "/root/testdata/sf0.01")
            .join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()]
    held = [r for r in rows if r[2]]
    assert len(held) > 100 and np.mean([r[1] == r[3] for r in held]) > 0.98 and all(0 <= r[4] <= 1 for r in rows)
    docs = docs_of(spark, ["the words are these", None, "", "12 34 !!", "x" * 200_000])
    m = lang.train(docs)
    got = {r.doc_id: r for r in lang.identify(docs.unionAll(docs), m).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred == "en"
    assert lang.identify(docs, lang.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert sorted(r.doc_id for r in lang.in_known_language(docs, m).collect()) == [0, 4]


def test_language_n_grams_and_sums_equal_the_feature_formula(monkeypatch):
    texts = ["One two two three", "é", "", None, "ab " * 500, "long" * 100, "a1b_c\n\nd", "İstanbul ǅ 中文"]

    def brute(text):
        w = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")
        return sum(len(x) + len(x) + 1 + len(x) for x in w if x), {(f" {x} ")[i:i + k] for x in w if x for k in (2, 3) for i in range(len(x) + 3 - k)} \
            | {c for x in w for c in x}

    for places in (1 << 19, 7):
        monkeypatch.setattr(lang, "_PLACES", places)
        for text in texts:
            u, c = lang.gram_counts(text)
            n, kinds = brute(text)
            assert c.sum() == n and 0.9 * len(kinds) <= len(u) <= len(kinds)
        own = np.concatenate([o for o, _ in lang.gram_buckets(texts)])
        assert np.bincount(own, minlength=len(texts)).tolist() == [brute(t)[0] for t in texts]
    assert set(lang.gram_counts("ab")[0]).isdisjoint(lang.gram_counts("cd")[0])
    rng = np.random.default_rng(2)
    m = lang.Model(["a", "b"], rng.random(lang.BUCKETS) + 1, rng.normal(size=(lang.BUCKETS, 2)), np.array([0.1, -0.1]), 0.7)
    found, score = m.predict(texts)
    for text, name, own in zip(texts, found, score, strict=True):
        u, c = lang.gram_counts(text)
        if not len(u):
            assert (name, own) == ("und", 0.0)
            continue
        z = m.logits(u, c.astype(float)) / 0.7
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert own == pytest.approx(p.max()) and name == "ab"[int(p.argmax())]
        assert m.predict([text]) == ([name], [own])  # whatever texts are beside it


# --- 3 -------------------------------------------------------------------------------------


def test_lines_and_common_subsequence():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        marks = shared_lines(a, b)
        sub = [x for x, s in zip(a, marks, strict=True) if s]
        it = iter(b)
        assert sum(marks) == lcs(a, b) and all(x in it for x in sub)
    page = "<header>Top</header><div class='cookie-notice'>We</div><main><h1>T &amp; x&#8217;</h1><p>One<br>two<p>b<script>x<p></script>" \
           "<div class=ad-slot>buy</div><section id=comments><p>nice</section></main><aside>s</aside><form>f</form><footer>&copy;"
    assert [t for t, k, _ in read_lines(page) if k == 2] == ["T & x’", "One two", "b"]
    assert read_lines("") == read_lines(None) == [] and [t for t, _, _ in read_lines("a < b <i title='x>c")][0].startswith("a < b")


def test_main_text_by_difference(spark):
    body = lambda i: f"<div>Site name</div><div><a href=/>Home</a></div><div>Story {i} begins here and goes on</div><div>It ends {i}</div><div>All the best</div>"
    rows = [(i, f"http://h.example/a/{i}", body(i), 1) for i in range(6)] + [(6, "http://other.example/x", "<article><p>Only</p></article>", 1),
            (7, None, None, 1), (8, "u", "", 1), (6, "http://other.example/x", "<article><p>Only</p></article>", 1), (9, "http://third.example/", "<p>Lone page</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract_main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    for i in range(6):
        assert text[i] == f"Story {i} begins here and goes on\n\nIt ends {i}"
    assert (text[6], text[7], text[8], text[9]) == ("Only", "", "", "Lone page")
    assert extract_main_text(df.limit(0)).count() == 0


def test_difference_decides_inside_articles_too(spark):
    story = lambda i: f"<p>Story {i} begins here and goes on</p><p>It ends {i}</p>"
    rows = [(i, f"http://main.example/a/{i}", f"<main><p>Read our other stories as well</p>{story(i)}</main>") for i in range(3)]
    rows += [(10 + i, f"http://teaser.example/a/{i}", f"<article><p>Win a journey</p></article><div>{story(i)}</div><div><a href=/>Home</a></div>") for i in range(3)]
    rows += [(20 + i, f"http://beside.example/a/{i}", f"<div>{'We are a paper of the town. ' * 9}</div><article>{story(i)}</article><div>Seen {i} times</div>") for i in range(3)]
    rows += [(30 + i, f"http://copy.example/a/{i}", f"<article>{story(7)}<p>Print {i}</p></article>") for i in range(2)]
    rows += [(40, "http://lone.example/a", f"<article><p>Win</p></article><div>{story(4)}</div>")]
    text = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(3):
        assert text[i] == text[10 + i] == text[20 + i] == f"Story {i} begins here and goes on\n\nIt ends {i}"
    assert [text[30 + i] for i in range(2)] == [f"Story 7 begins here and goes on\n\nIt ends 7\n\nPrint {i}" for i in range(2)]
    assert text[40] == "Win\n\nStory 4 begins here and goes on\n\nIt ends 4"


def test_article_lines_of_two_neighbours_stay_unless_half_of_the_host_has_them(spark):
    page = lambda i: f"<article><p>Follow us</p><p>Story {i} begins here and goes on for long</p><p>{'More soon' if i < 2 else f'End {i}'}</p></article>"
    rows = [(i, f"http://h.example/a/{i}", page(i)) for i in range(8)] + [(0, "http://h.example/a/0", page(0))] * 20
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert [text[i] for i in range(8)] == [f"Story {i} begins here and goes on for long\n\n{'More soon' if i < 2 else f'End {i}'}" for i in range(8)]


# --- 5 -------------------------------------------------------------------------------------


def _sellers(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != x)))
        row, best = new, min(best, new[-1])
    return best


def _edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        p = rng.randrange(len(s))
        s[p:p + rng.randrange(2)] = rng.choice("abcdefg ") * rng.randrange(1, 2)
    return "".join(s)


def test_exact_verification_is_the_smallest_distance():
    rng = random.Random(5)
    for _ in range(200):
        item, text = ("".join(rng.choice("ab ") for _ in range(rng.randint(1, n))) for n in (12, 30))
        got, want = smallest_distance(item, text, 4), _sellers(item, text)
        assert (got[0] if got else 99) == (want if want <= 4 else 99)


def test_leaks_against_brute_force_and_recall(spark):
    rng = random.Random(6)
    items = [(i, words(rng, rng.randint(14, 60), POOL)) for i in range(40)] + [(90, None), (91, ""), (40, "Short one")]
    clean = [words(rng, rng.randint(0, 200), POOL) for _ in range(120)]
    docs, planted = list(clean), {}
    for i, t in items[:40]:
        planted[len(docs)] = i
        docs.append(f"{rng.choice(clean)}. {_edited(rng, t, len(t) // 10).upper()}! {rng.choice(clean)}")
    docs += [None, "", items[3][1] + " " + items[3][1], "a short  one."]
    df = docs_of(spark, docs)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, start int")
    got = {(r.doc_id, r.item_id): r.distance for r in find_leaks(df.unionAll(df), bench).collect()}
    caught = sum((d, i) in got for d, i in planted.items())
    assert caught >= 0.95 * len(planted) and got[162, 3] == 0
    for (d, i), dist in got.items():
        item = normalise(dict(items)[i])
        assert dist <= 0.2 * len(item) and dist == _sellers(item, normalise(docs[d]))
    want = {(d, i) for d, t in enumerate(docs) for i, x in items if normalise(x) and normalise(x) in normalise(t)}
    assert want <= set(got) and not [k for k in got if k[0] < 120 and k not in want]
    kept = {r.doc_id for r in without_leaks(df, bench).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in got}
    assert find_leaks(df, bench.limit(0)).count() == 0 and find_leaks(df.limit(0), bench).count() == 0
    assert ItemIndex([(1, "abc " * 50)]).scan([None, ""]) == []


@pytest.mark.parametrize("first, last", [(0x4E00, 0x9FFF), (0x3041, 0x3096), (0x0E01, 0x0E30)])
def test_unedited_passages_of_scripts_without_word_spaces(first, last):
    rng = random.Random(11)
    text = lambda n: "".join(chr(rng.randint(first, last)) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((6, 20, 40, 90, 200, 400))]
    docs = [text(rng.randint(1, 80)) + t + text(rng.randint(1, 80)) for _, t in items]
    got = {(r[0], r[1]): r[2] for r in ItemIndex(items).scan([*docs, text(500)])}
    assert got == {(i, i): 0 for i in range(len(items))}


# --- 6 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("tile_bytes", [1 << 12, 1 << 20])
def test_cosine_components_against_brute_force(spark, tile_bytes):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base[:20] + 0.12 * rng.normal(size=(20, 24)), base[:10] * 3, np.repeat(base[:1], 30, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] * 24, 0), (1003, [None] * 24, 0), (1004, [], 0), (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cosine_components(df, tile_bytes=tile_bytes).collect()}
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = list(range(len(x)))
    for _ in x:
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    for i in range(len(x)):
        assert got[i] == (near[i].sum(), comp[i], comp[i] == i)
    assert all(got[i] == (0, i, True) for i in range(1000, 1005)) and got[1005] == (1, 1005, True) and got[1006] == (1, 1005, False)
    assert cosine_components(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 7 -------------------------------------------------------------------------------------


def test_warc_round_trip_and_revisits(spark, tmpdir_path):
    big = "<p>é" + "x" * 1000
    rows = [(1, "http://a b/ü", big, 0), (5, None, big, 0), (3, "http://c/\n", big, 0), (2, "d", "small", 0), (4, "d", "small", 0), (6, "e", None, 0), (7, "f", "", 0), (None, "g", "z", 0), (5, None, big, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, head int")
    listed = write_archives(df, f"file://{tmpdir_path}/a", archive_bytes=200)
    assert listed.count() > 1
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archives(listed, f"file://{tmpdir_path}/a").collect())
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        if i is not None:
            revisit = h == big and i != 5
            want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want, key=lambda r: r[:4])
    assert read_archives(write_archives(df.limit(0), f"file://{tmpdir_path}/b"), f"file://{tmpdir_path}/b").count() == 0


def _zip64(members):
    out, central = io.BytesIO(), b""
    for name, data in members:
        at, crc, name = out.tell(), zlib.crc32(data), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out.write(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra)) + name + extra + data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        central += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = out.tell()
    out.write(central)
    end = out.tell()
    out.write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, len(members), len(members), len(central), start))
    out.write(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
    out.write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 8) + b"PK\x05\x06 end")
    return out.getvalue()


def test_zip_directories_with_zip64_and_comments():
    records = [b"first", b"", b"third" * 1000]
    plain = pack_archive(records, [1, 2, 3])
    with zipfile.ZipFile(io.BytesIO(plain)) as z:
        members = [(n, z.read(n)) for n in z.namelist()]
    wide = _zip64(members)
    for raw in (plain, wide):
        f = io.BytesIO(raw)
        for name, m in central_directory(f, len(raw)).items():
            at = stored_start(f, m)
            assert raw[at:at + m["size"]] == dict(members)[name]
        assert list(range_read(f, len(raw))) == records
    with pytest.raises(ValueError):
        central_directory(io.BytesIO(b"nothing"), 7)


# --- 8 -------------------------------------------------------------------------------------


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(8)
    est, exact = [], []
    for _ in range(40):
        keys = np.sort(rng.choice(1 << 40, 60, replace=False).astype(np.uint64))
        x, y = (np.where(rng.random(60) < 0.85, rng.integers(1, 4, 60), 0) for _ in range(2))
        want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(60)) for i in range(60) if x[i] and y[i])
        a, b = (Counted(keys[c > 0], c[c > 0]) for c in (x, y))
        assert probability_jaccard(a, b) == pytest.approx(want)
        owner = np.repeat([0, 1], [len(a.shingles), len(b.shingles)])
        win = signatures(owner, np.concatenate([a.shingles, b.shingles]), np.concatenate([a.counts, b.counts]).astype(float), 2, 512)
        est.append((win[0] == win[1]).mean())
        exact.append(want)
    assert abs(np.mean(est) - np.mean(exact)) < 0.01


def _classes(texts):
    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        k = min(5, len(w))
        return Counted(*np.unique(np.array([zlib.crc32(" ".join(w[i:i + k]).encode()) for i in range(len(w) - k + 1)], np.uint64), return_counts=True)) if w else None
    s = [shingles(t) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if s[i] and s[j] and comp[i] != comp[j] and probability_jaccard(s[i], s[j]) >= 0.8:
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    return comp


@pytest.mark.parametrize("block", [4, 128])
def test_near_duplicates_against_brute_force(spark, block):
    rng = random.Random(9)
    texts = [words(rng, rng.randint(1, 120), POOL) for _ in range(60)]
    for i in range(25):
        w = texts[i].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w).upper())
    base = words(rng, 100, POOL)
    for _ in range(40):  # one crowd around a text
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(POOL)
        texts.append(" ".join(w))
    texts += [None, "", "...", "same words", "Same, words!", "line\n" * 5000]
    df = docs_of(spark, texts)
    got = {r.doc_id: r for r in near_duplicates(df.unionAll(df.limit(5)).unionAll(spark.createDataFrame([(None, "same words", *[None] * 5)], DOC)), block=block).collect()}
    assert [got[i].class_id for i in range(len(texts))] == _classes(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values()) and len(got) == len(texts)
    assert near_duplicates(df.limit(0)).count() == 0


# --- 9, 10 ---------------------------------------------------------------------------------


def test_licence_rules(spark):
    texts = ["Intro.\nLicensed under the Apache License, Version 2.0.\nRest", "Released under the MIT License.", "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.",
             "a licence is mentioned here", None, "", "Permission is granted " * 5000, "This work is licensed under the GNU General Public License, version 3. This work is licensed under the GNU General Public License, version 3."]
    got = {r.doc_id: (r.sentences, r.licences) for r in scan_licences(docs_of(spark, texts)).collect()}
    assert got[0] == (["Apache2Ref"], ["Apache-2.0"]) and got[1][1] == ["MIT"]
    assert got[2] == (["CCBYNCRef", "Apache2Ref"], ["Apache-2.0", "CC-BY-NC-4.0"])
    assert got[3] == got[4] == got[5] == got[6] == ([], []) and got[7][1] == ["GPL-3.0"]


def test_adjacent_notices_slots_and_spdx_lines(spark):
    bsd3 = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
            "3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without "
            "specific prior written permission.\n\n")
    free = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License{} as published by the Free Software Foundation{}."
    later = "; either version {} of the License, or (at your option) any later version"
    texts = [(bsd3.format("the copyright holder") * 2, ["BSD-3-Clause"]), (bsd3.format("Acme Ltd. and Sons"), ["BSD-3-Clause"]),
             (bsd3.format("Acme") + bsd3.split("3. ")[0], ["BSD-3-Clause", "BSD-2-Clause"]),
             (free.format("library", "Lesser ", "", later.format("2.1")), ["LGPL-2.1-or-later"]),
             (free.format("program", "Affero ", "", later.format("3")), ["AGPL-3.0-or-later"]),
             (free.format("program", "", " version 2", ""), ["GPL-2.0-only"]),
             ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]), ("# SPDX-License-Identifier: GPL-2.0-or-later\n", ["GPL-2.0-or-later"]),
             ("The project is licensed under the MIT License.", ["MIT"])]
    got = {r.doc_id: r.licences for r in scan_licences(docs_of(spark, [t for t, _ in texts])).collect()}
    assert [got[i] for i in range(len(texts))] == [x for _, x in texts]


NOTICES = {
    "Apache-2.0": (["Apache2Ref", "Apache2Use", "Apache2Copy", "Apache2AsIs"],
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   'You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to '
                   'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
                   'either express or implied.'),
    "MIT": (["MITRef", "MITGrant", "MITNotice"],
            'The MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
            'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
            'publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject '
            'to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    "GPL-3.0-or-later": (["GPLFree", "GPLNoWarranty"],
                         "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                         "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
                         "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "GPL-2.0-or-later": (["GPL2Free"],
                         "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                         "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "BSD-3-Clause": (["BSDRedistribute", "BSDNoEndorse"],
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                     "redistributions keep this list.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    "MPL-2.0": (["MPL2Ref", "MPL2Copy"],
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at http://mozilla.org/MPL/2.0/."),
    "ISC": (["ISCGrant"],
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
}


def _wrapped(text, width, mark):
    return "\n".join((mark + line).rstrip() for part in text.split("\n") for line in textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False) or [""])


def test_licence_texts_as_distributed(spark):
    want, texts = [], []
    for name, (ids, text) in NOTICES.items():
        for form in (text, *(_wrapped(text, w, m) for w, m in ((72, ""), (40, "# "), (60, " * "), (60, "// "), (66, "dnl ")))):
            want.append((ids, [name]))
            texts.append(f"Some words before.\n{form}\nand after them")
    known = {i for _, ids in RULES for i in ids}
    for i, sentences in SENTENCES.items():  # every sentence of the table, cut anywhere
        for s in sentences:
            for w in (9, 25, 60):
                want.append(([i], [next(n for n, ids in RULES if ids == [i])] if i in known and [i] in [x for _, x in RULES] else []))
                texts.append(_wrapped(s, w, "# "))
    got = {r.doc_id: (r.sentences, r.licences) for r in scan_licences(docs_of(spark, texts)).collect()}
    assert [(texts[i], got[i]) for i in got if got[i] != want[i]] == []


def test_pieces_against_brute_force_and_round_trip(spark):
    import sentencepiece
    known = Pieces.load()
    codec, model = Codec(known), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    score = {p: (known.scores[i], i) for i, p in enumerate(known.pieces) if i not in set(known.special)}
    lost = min(s for s, _ in score.values()) - UNKNOWN

    def brute(text):
        t = SPACE + text.replace(" ", SPACE)
        best = [(0.0, [])]
        for e in range(1, len(t) + 1):
            options = []
            for s in range(max(0, e - 20), e):
                if t[s:e] in score:
                    options.append((best[s][0] + score[t[s:e]][0], s, [score[t[s:e]][1]]))
            if t[e - 1] not in score:
                options.append((best[e - 1][0] + lost, e - 1, [known.byte_ids[b] for b in t[e - 1].encode()]))
            top = max(o[0] for o in options)
            s, ids = min((o[1], o[2]) for o in options if o[0] == top)
            best.append((top, best[s][1] + ids))
        return best[-1][1]

    rng = random.Random(10)
    texts = ["Hello  world\n\t x ü 漢 🙂 ", " ", "a", "   b", "\n\n"] + ["".join(rng.choice("the anion gß 漢\n.") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    for t in texts:
        ids = codec.encode(t).tolist()
        assert ids == brute(t) and codec.decode(ids) == t == model.decode(ids)
    rows = {r.doc_id: r for r in encode_documents(docs_of(spark, [*texts[:5], None, "", "x" * 300_000])).collect()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows.values()) and rows[5].n_tokens == rows[6].n_tokens == 0
    assert rows[0].n_byte_tokens > 0 and encode_documents(docs_of(spark, ["a"]).limit(0)).count() == 0


# --- the pipeline --------------------------------------------------------------------------


def test_pipeline_stages_against_their_operators(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_nth", F.lit(1)).withColumn("id", F.lit("x"))
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        after = written(stage(spark, docs, SF), "test")
        now = {r.doc_id for r in after.select("doc_id").collect()}
        assert now <= before
        if name == "near_duplicates":
            ids = sorted(before)
            assert now == {i for i, c in zip(ids, _classes([seen[i] for i in ids]), strict=True) if ids[c] == i}
        if name == "decontamination":
            items = [normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not [i for i in now if any(x in normalise(seen[i]) for x in items)]
            assert all(any(_sellers(x, normalise(seen[i])) <= 0.2 * len(x) for x in items) for i in before - now)
        if name != "tokenise":
            assert after.columns == docs.columns
        docs = after
    assert {r.doc_id for r in P.run(spark, SF).collect()} == now
    for name, stage in P.STAGES[2:]:
        odd = docs_of(spark, ["one text", "one text", None, ""]).unionAll(spark.createDataFrame([(None, "n", *[None] * 5)], DOC))
        assert stage(spark, odd, SF).count() == {"near_duplicates": 4, "decontamination": 5, "tokenise": 5}[name]
