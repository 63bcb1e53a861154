"""Each operator against a brute-force version, its library, or SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from lumenpair.llm import (
    decontaminate,
    fingerprints,
    hard_negatives,
    minhash_join,
    ngram_join,
    queries,
    quote_links,
    secrets,
    sentencepiece_lattice,
    spelling_groups,
    substring_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from lumenpair.llm import groups as candidate_groups

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    return dict(connect(SMALL).sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) is None


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/a?x#y", "https://a.net/fr", "https://a.net/fr/", "x", None, "http://é.COM/", "ftp://q.org?utm_source=a&b=1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("q.org?b=1",), (None,)], "u string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, listed, queries.URL_RULES).collect()}
    assert [got[i].host for i in range(7)] == ["www.example.com", "a.net", "a.net", "", "", "é.com", "q.org"]
    assert [got[i].path for i in range(7)] == ["/en/a", "/fr", "/fr/", "", "", "/", ""]
    assert [got[i].rule for i in range(7)] == ["www.example.com/en/", None, "net/fr/", None, None, "com/", None]
    assert [got[i].verdict for i in range(7)] == ["allow", "allow", "block", "allow", "allow", "allow", "block"]


def test_bloom_filter_has_no_false_negative(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    other = spark.range(5000).select(F.concat(F.lit("o"), "id").alias("k"))
    blocks = 5000 * url_filter.BITS_PER_KEY // url_filter.BITS_PER_BLOCK
    stored = url_filter.bloom_blocks(keys, "k", blocks)
    assert url_filter.passes(keys, F.col("k"), stored, blocks).where("__maybe").count() == 5000
    assert url_filter.passes(other, F.col("k"), stored, blocks).where("__maybe").count() < 100


def test_substring_dedup(spark):
    rnd = random.Random(3)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = ". ".join(words(9) for _ in range(7)) + "."
    docs = {i: f"{words(12)}. {words(4)} {passage if i in (3, 7, 9) else words(30)} {words(8)}.\nshort line." for i in range(12)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = substring_dedup.repeated_units(df)
    removed = defaultdict(list)
    for r in got.collect():
        removed[r.doc_id].append(docs[r.doc_id][r.start_char : r.end_char])
        origin = docs[r.first_doc_id][r.first_char : r.first_char + r.end_char - r.start_char]
        assert origin.lower().split() == removed[r.doc_id][-1].lower().split()
    assert set(removed) == {7, 9}
    assert all(sum(len(u.split()) for u in us) >= 54 for us in removed.values())
    kept = {r.doc_id: r for r in substring_dedup.remove_repeats(df, got).collect()}
    assert kept[3].text == docs[3]
    for i, r in kept.items():
        assert r.text == "".join(docs[i][s.start_char : s.end_char] for s in r.kept_spans)


def test_substring_units_against_brute_force(spark, texts):
    first, counts = {}, Counter()
    found = {i: list(substring_dedup.units_of(t)) for i, t in texts.items()}
    for i in sorted(found):
        for start, _, _, digest in found[i]:
            counts[digest] += 1
            first.setdefault(digest, (i, start))
    want = set()
    for i, units in found.items():
        run = []
        for unit in [*units, None]:
            if unit and counts[unit[3]] > 1 and first[unit[3]] != (i, unit[0]):
                run.append(unit)
                continue
            if sum(u[2] for u in run) >= substring_dedup.MIN_WORDS:
                want |= {(i, u[0], u[1], *first[u[3]]) for u in run}
            run = []
    got = queries.QUERIES["op2_substring_dedup"](spark, SMALL)
    assert {(r.doc_id, r.start_char, r.end_char, r.first_doc_id, r.first_char) for r in got.collect()} == want


def test_whole_lines_against_brute_force(spark):
    texts = dict(connect("/root/testdata/sf0.01").sql("SELECT doc_id, text FROM documents").fetchall())
    same = lambda t: " ".join(t.lower().split())
    first, want, lines = {}, defaultdict(set), Counter()
    for i in sorted(texts):
        at = 0
        for line in texts[i].split("\n"):
            spans = [(m.start(), m.end()) for m in re.finditer(r"(?:(?![.!?] ).)+[.!?]?", line)] if line.strip() else []
            for a, b in sorted({*spans, (0, len(line))}) if spans else ():
                first.setdefault(same(line[a:b]), (i, at + a))
            if line.strip() and first[same(line)] != (i, at):
                want[i].add((at, at + len(line.rstrip())))
                lines[same(line)] += 1
            at += len(line) + 1
    assert sum(n for t, n in lines.items() if len(t.split()) < substring_dedup.MIN_WORDS) > 100
    gone = defaultdict(set)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in substring_dedup.repeated_units(docs, whole_lines=True).collect():
        gone[r.doc_id].update(range(r.start_char, r.end_char))
    assert [(i, s) for i, found in want.items() for s in found if not gone[i].issuperset(range(*s))] == []


def test_whole_lines(spark):
    docs = [
        (1, "A licence line. Of two sentences.\nShort one.\nsome text. Chance repeat. more text"),
        (2, "a  licence line. Of two sentences. \nother text. Chance repeat. end of it"),
        (3, "Short one.\nChance repeat.\nOf two sentences."),
        (4, "x y. Short one. A licence line."),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = substring_dedup.repeated_units(df, whole_lines=True).collect()
    found = {(r.doc_id, dict(docs)[r.doc_id][r.start_char : r.end_char], r.first_doc_id, r.first_char) for r in got}
    assert len(got) == 4 and found == {
        (2, "a  licence line. Of two sentences.", 1, 0), (3, "Short one.", 1, 34), (3, "Chance repeat.", 1, 56), (3, "Of two sentences.", 1, 16),
    }
    assert substring_dedup.repeated_units(df).collect() == []


def test_deduplicated_texts(spark, texts):
    got = queries.QUERIES["op2_whole_line_dedup"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and any(r.removed_spans for r in got)
    for r in got:
        whole = texts[r.doc_id] or ""
        assert r.text == "".join(whole[s.start_char : s.end_char] for s in r.kept_spans) and r.n_chars == len(r.text)
        kept = {i for s in r.kept_spans for i in range(s.start_char, s.end_char)}
        gone = {i for s in r.removed_spans for i in range(s.start_char, min(len(whole), s.end_char + 1))}
        assert kept == set(range(len(whole))) - gone
        for s in r.removed_spans:
            origin = texts[s.first_doc_id][s.first_char :].lower().split()
            unit = whole[s.start_char : s.end_char].lower().split()
            assert origin[: len(unit)] == unit


def test_repeats_of_rows_without_an_id(spark):
    docs = [(None, "one line\nof its own"), (None, "own text\none line"), (None, "own text\none line"), (1, "one line"), (1, "x\none line"), (2, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = substring_dedup.remove_repeats(df, substring_dedup.repeated_units(df, whole_lines=True)).collect()
    left = Counter((r.doc_id, r.text) for r in got)
    # Which of the two texts without an id comes first is up to a hash.
    assert sum(left.values()) == 6 and left[1, ""] == left[1, "x\n"] == left[2, None] + left[2, ""] == 1
    assert left in (
        Counter({(None, docs[0][1]): 1, (None, "own text\n"): 2, (1, ""): 1, (1, "x\n"): 1, (2, ""): 1}),
        Counter({(None, "of its own"): 1, (None, docs[1][1]): 2, (1, ""): 1, (1, "x\n"): 1, (2, ""): 1}),
    )


def test_token_counts(spark, texts, tmp_path):
    odd = ["", None, " á\tb", "X<|endoftext|>y <|startoftext|>", "ΟΔΟΣ. İ", "it's, a., b.. c", "中文 字.\u0085", "\x1c\x1d a\r\n", "9" * 300]
    rows = [*texts.items(), *[(10_000 + i, t) for i, t in enumerate(odd)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    library = token_counts.load_tokenizer(WORD_BPE)
    want = {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in rows}
    for _ in range(2):  # the second time from the cache
        got = token_counts.count_tokens(df, WORD_BPE, str(tmp_path / "cache")).collect()
        assert {r.doc_id: r.n_tokens for r in got} == want
        assert all(r.n_bytes == len((dict(rows)[r.doc_id] or "").encode()) for r in got)
    stored = token_counts.read_cache(spark, str(tmp_path / "cache"))
    assert stored.count() == stored.select("digest").distinct().count()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    out = labels.where("doc_id % 4 = 0")
    models = toxicity.fit_chain(docs, labels.where("doc_id % 4 > 0"), queries.CATEGORIES, max_rows=3000)
    judged = toxicity.score_chain(docs.join(out.select("doc_id"), "doc_id"), models, list(queries.CATEGORIES))
    rows = judged.join(out, "doc_id").collect()
    caught = [r.p_toxic >= queries.THRESHOLD for r in rows if r.toxic]
    wrong = [r.p_toxic >= queries.THRESHOLD for r in rows if not r.toxic]
    assert np.mean(caught) > 0.9 and np.mean(wrong) < 0.05


def test_secret_base_spans_and_method(spark, texts):
    assign = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    odd = [
        'secret=token": abcdefg API_KEY:"aé" apikey = \'abcdef\'', "é" * 5 + "AKIA" + "Z" * 15, "é AKIA" + "Z" * 16 + "ab" * 13,
        "key q8Zr2LxV0pTn7YwKs3Jd9 and anotherordinarylongidentifier", "token=" + "x" * 5 + " token=" + "x" * 6,
    ]
    rows = [*texts.items(), *[(10_000 + i, t) for i, t in enumerate(odd)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = ["assign", "access", "hex"]
    for r in secrets.scan_report(df).collect():
        t = dict(rows)[r.doc_id]
        want = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want.sort(key=lambda s: (s[1], kinds.index(s[0])))
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == [s for s in listed.split(",") if s]


def test_markov_ratio(spark):
    counts = [(True, a + b, 3) for a in "qzx7Q" for b in "qzx7Q"] + [(False, p, 9) for p in ("th", "he", "er", "re", "et")]
    table = secrets.ratio_table(counts)

    def mean(s):
        at = [secrets.LETTERS.index(c) for c in s]
        return sum(table[a * secrets.SIZE + b] for a, b in zip(at, at[1:])) / (len(s) - 1)

    words = ["thethereththeretheret", "qz7xQqz7xQqz7xQqz7xQq", "a_b-c/d+e0123456789ab"]
    df = spark.createDataFrame([(w,) for w in words], "s string").select("s", secrets.mean_ratio(F.col("s"), table).alias("v"))
    for r in df.collect():
        assert math.isclose(r.v, mean(r.s), abs_tol=1e-9)
    assert mean(words[1]) > 0.5 > mean(words[0])


def test_masking(spark):
    df = spark.createDataFrame([("aé123bb456", [(2, 5), (7, 9), (8, 10)]), ("x", []), ("", [])], "t string, s array<struct<start:bigint,end:bigint>>")
    assert [r[0] for r in df.select(secrets.masked(F.col("t"), F.col("s"), "#")).collect()] == ["aé#bb#", "x", ""]


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))


def groups(texts, similarity=75):
    sets = {i: shingles(t) for i, t in texts.items()}
    holders, shared, parent = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for h in s:
            shared.update((j, i) for j in holders[h])
            holders[h].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= similarity * (len(sets[a]) + len(sets[b]) - n):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = "edit%d" % rnd.randrange(10**6)
    return " ".join(out)


def test_token_counts_of_a_cased_tokenizer_and_a_doubled_cache(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.BPE(vocab={"A": 0, "B": 1, "AB": 2, "a": 3, "b": 4}, merges=[("A", "B")]))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    path, cache = str(tmp_path / "cased.json"), str(tmp_path / "cache")
    own.save(path)
    assert token_counts.words_apart(path) and not token_counts.folds_words(path)
    assert token_counts.folds_words(WORD_BPE)
    docs = [(1, "AB AB"), (2, "ab A"), (3, None), (4, "AB AB")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in docs}
    for _ in range(2):  # the second run finds every digest stored twice
        got = token_counts.count_tokens(df, path, cache).collect()
        assert len(got) == len(docs) and {r.doc_id: r.n_tokens for r in got} == want
        stored = spark.read.parquet(cache)
        rows = stored.collect()
        spark.createDataFrame(rows, stored.schema).write.mode("append").parquet(cache)


def near_copies(texts):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(500)}" for _ in range(150)]
    docs = dict(list(texts.items())[:60])
    # A group around the similarity, exact copies, short texts, shared passages, long texts.
    for i in range(60):
        docs[1000 + i] = edited(rnd, base, rnd.randrange(6))
    docs |= {2000: "One Two", 2001: "one  two", 2002: "one", 2003: "", 2004: " \n", 2005: docs[1000]}
    passage = " ".join(base[:30])
    docs |= {3000 + i: passage + " " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 12))) for i in range(20)}
    long = [f"v{rnd.randrange(10**5)}" for _ in range(3000)]
    docs |= {4000 + i: edited(rnd, long, 25 * i) for i in range(8)}
    return docs


@pytest.mark.parametrize("block", [3, 512])
def test_ngram_join(spark, texts, monkeypatch, block):
    monkeypatch.setattr(candidate_groups, "BLOCK", block)
    docs = near_copies(texts)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect()}
    assert got == groups(docs)


@pytest.mark.parametrize("block", [3, 512])
def test_minhash_join(spark, texts, monkeypatch, block):
    monkeypatch.setattr(candidate_groups, "BLOCK", block)
    docs = near_copies(texts)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_join.near_duplicates(df).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in groups(docs, 85).items()}


def test_match_threshold_and_collisions():
    """Pairs right at the similarity pass; the rate of collisions follows the similarity."""
    t = minhash_join.match_threshold(85)
    miss = sum(math.comb(64, k) * 0.85**k * 0.15 ** (64 - k) for k in range(t))
    assert miss < minhash_join.MISS <= miss + math.comb(64, t) * 0.85**t * 0.15 ** (64 - t)
    rnd = np.random.default_rng(4)
    rates = []
    for _ in range(60):
        pool = rnd.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = np.sort(pool[:370]), np.sort(pool[30:])  # 340 of 400 are shared
        rates.append((minhash_join.signature_of(a) == minhash_join.signature_of(b)).mean())
    assert abs(np.mean(rates) - 0.85) < 0.02


def mined(rows, every=50, positives=5, negatives=3, window=(50, 95)):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = sorted({(i, c, tuple(math.floor(256 * x) for x in v)) for i, c, v in rows if i is not None and c is not None and ok(v)})
    out = []
    for i, c, v in [r for r in rows if r[0] % every == 0]:
        scored = [(-sum(x * y for x, y in zip(v, w)), j, d) for j, d, w in rows if j != i and len(w) == len(v)]
        for p, j, _ in sorted(x for x in scored if x[2] == c)[:positives]:
            fits = sorted((s, k) for s, k, d in scored if d != c and window[0] * -p <= 100 * -s <= window[1] * -p)
            out += [(i, j, n + 1, k, -p, -s) for n, (s, k) in enumerate(fits[:negatives])]
    return out


def test_hard_negatives(spark, monkeypatch):
    """Many small tiles, pages, blocks and runs; ties, equal vectors, two widths, odd rows."""
    for name, value in {"MAX_TILE_ROWS": 5, "LEAF": 2, "PAGE_TILES": 3, "RUN_TILES": 2, "BLOCK_QUERIES": 4}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rnd = np.random.default_rng(12)
    rows = [(int(i), int(rnd.integers(0, 4)), np.round(rnd.normal(size=6), 1).tolist()) for i in range(160)]
    rows += [(200 + i, 1, [0.5] * 6) for i in range(40)]
    rows += [(300 + i, int(rnd.integers(0, 3)), rnd.normal(size=3).tolist()) for i in range(30)]
    rows += [(None, 1, [1.0] * 6), (401, None, [1.0] * 6), (402, 1, None), (403, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, 1, [float("nan")] * 6)]
    rows += [(404, 1, [float("inf")] + [0.0] * 5), (450, 2, []), (451, 2, []), (452, 3, []), rows[0], (0, 2, rows[1][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, __x string")
    got = [tuple(r) for r in hard_negatives.hard_negatives(df, every=10).collect()]
    assert sorted(got) == sorted(mined(rows, every=10)) and len(got) > 200
    assert hard_negatives.hard_negatives(df.limit(0)).collect() == []
    assert hard_negatives.hard_negatives(df.where("vec_id % 50 <> 0")).collect() == []


def test_bounds_hold_every_score():
    rnd = np.random.default_rng(2)
    x, q = np.floor(rnd.normal(size=(500, 8)) * 256), np.floor(rnd.normal(size=(20, 8)) * 256)
    order, ends = hard_negatives.leaf_order(x)
    assert sorted(order.tolist()) == list(range(500)) and max(np.diff([0, *ends])) <= hard_negatives.LEAF
    blob = lambda a, t: np.ascontiguousarray(a, t).tobytes()
    block = {"__query": blob(range(20), np.int64), "__id": blob(range(-20, 0), np.int64), "__label": blob([0] * 20, np.int64),
             "__least": blob([-np.inf] * 20, float), "__most": blob([np.inf] * 20, float), "__x": blob(q, float), "__width": 8}
    own = hard_negatives.Queries(block, 3, True)
    assert (own.bounds(x, x) == q @ x.T).all()
    assert (own.bounds(x.min(axis=0)[None], x.max(axis=0)[None])[:, 0] >= (q @ x.T).max(axis=1)).all()
    own.walk({"__ids": blob(order, np.int64), "__ends": blob(ends, np.int32), "__x": blob(x[order], float), "__label": 0})
    want = [sorted(range(500), key=lambda j: (-s[j], j))[:3] for s in q @ x.T]
    assert own.ids.tolist() == want


def spelled(docs, least_length=6, least_count=5):
    import zlib

    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = defaultdict(set)
    deleted = defaultdict(list)
    for w in words:
        for i in range(len(w)):
            deleted[w[:i] + w[i + 1 :], i].append(w)
            if (shorter := w[:i] + w[i + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in deleted.values():
        for w in same:
            near[w] |= set(same) - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


@pytest.mark.parametrize("chunk", [3, 1024])
def test_spelling_groups(spark, texts, monkeypatch, chunk):
    visits = spelling_groups.visits
    monkeypatch.setattr(spelling_groups, "visits", lambda words, classes: visits(words, classes, chunk))
    rnd = random.Random(7)
    docs = list(texts.items())[:80]
    roots = ["étranger", "Straßenbahn", "abcdefgh", "aabbaabb", "z" * 300]
    for k, w in enumerate(roots):
        docs += [(5000 + 1000 * k + i, f"{w} {w.upper()}") for i in range(40)]
        for _ in range(12):
            j = rnd.randrange(len(w))
            variant = w[:j] + rnd.choice(["", "x", "é", w[j] + "q"]) + w[j + 1 :]
            docs += [(20_000 + 100 * k + i, " ".join([variant] * rnd.randrange(1, 4))) for i in range(4)]
    docs += [(None, "abcdefgh abcdefgx"), (7, None), (8, ""), (9, "×÷×÷×÷ " * 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_groups.spelling_groups(df).collect()}
    assert got == spelled(docs)
    assert any(f and got[f][2] for _, _, f, _, _ in got.values()) or chunk  # chains of forms may occur
    assert spelling_groups.spelling_groups(df.limit(0)).collect() == []


def test_bitmap_bound():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rnd.integers(0, 1 << 62, 300).astype(np.uint64))
        b = np.unique(np.append(a[rnd.random(len(a)) < 0.8], rnd.integers(0, 1 << 62, 40).astype(np.uint64)))
        bits = int(np.bitwise_count(ngram_join.bitmap_of(a) ^ ngram_join.bitmap_of(b)).sum())
        assert bits <= len(np.setxor1d(a, b))


def edit_distance(item, text):
    before = list(range(len(item) + 1))
    best = before[-1]
    for c in text:
        now = [0]
        for j in range(1, len(item) + 1):
            now.append(min(before[j - 1] + (item[j - 1] != c), before[j] + 1, now[-1] + 1))
        before, best = now, min(best, now[-1])
    return best


def test_decontamination(spark):
    rnd = random.Random(2)
    items = [(i, "".join(rnd.choice("abcd ") for _ in range(rnd.randint(3, 70))).strip() or "x") for i in range(12)]
    docs = []
    for i in range(60):
        t = list("".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 60))) + rnd.choice(items)[1] + "abcd" * 4)
        for _ in range(rnd.randint(0, 8)):
            j = rnd.randrange(len(t))
            t[j : j + rnd.randint(0, 1)] = rnd.choice(["", "D"])
        docs.append((i, "".join(t)))
    index = decontaminate.index_items(items, 4, 0.12)
    df, bench = (spark.createDataFrame(x, s) for x, s in ((docs, "doc_id long, text string"), (items, "item_id long, text string")))
    found = decontaminate.contaminations(df, bench, q=4, rate=0.12).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in sorted(found, key=lambda r: -r.edits)}
    text = lambda points: "".join(map(chr, points))
    for i, t in docs:
        for item, points, budget in zip(index.ids, index.texts, index.budgets):
            d = edit_distance(text(points), text(decontaminate.normalise(t)[0]))
            assert got.get((i, item)) == (d if d <= budget else None)
    for r in found:
        assert edit_distance(text(decontaminate.normalise(docs[r.doc_id][1][r.start_char : r.end_char])[0]), text(index.texts[r.item_id])) <= 2 * r.edits + 1


def test_decontamination_in_blocks(spark, texts, monkeypatch):
    items = connect(SMALL).sql("SELECT item_id, text FROM benchmark").fetchall()
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda t: " ".join(t.lower().split())
    want = {(i, k) for i, t in texts.items() for k, x in items if flat(x) in flat(t)}
    for size in (1 << 22, 500):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        found = decontaminate.contaminations(docs, bench).collect()
        assert {(r.doc_id, r.item_id) for r in found if r.edits == 0} == want


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there\n\nSecond paragraph"),
        (1, 1, "a", "> Second  PARAGRAPH\nI agree"),
        (1, 2, "u", ">> Second paragraph\n> I agree\nMe too\n>no such text"),
        (1, 3, "a", "> Hello there\n>\n> Second paragraph\nback to the start"),
        (2, 0, "u", "I agree"),
        (2, 1, "a", "> Hello there\n"),
    ]
    got = {(r.conv_id, r.turn): r for r in quote_links.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t].parent_turn for t in range(4)] == [None, 0, 1, 0]
    assert [got[1, t].depth for t in range(4)] == [0, 1, 2, 1]
    assert [got[1, t].text for t in range(4)] == [rows[0][3], "I agree", "Me too", "back to the start"]
    assert (got[1, 2].n_quotes, got[1, 2].n_linked) == (3, 2)
    assert got[2, 1].parent_turn is None and got[2, 1].root_turn == 1


def test_long_thread(spark):
    df = spark.range(300).selectExpr("1L conv_id", "id turn", "'u' role", "concat('text ', id) text")
    got = quote_links.link_conversations(quote_links.as_mail(df)).collect()
    assert all(r.root_turn == 0 and r.depth == r.turn for r in got)


def test_fingerprints(spark):
    rnd = random.Random(4)
    word = lambda: "w%d" % rnd.randrange(300)
    base = [word() for _ in range(400)]
    docs = {i: " ".join(w if rnd.random() > i / 40 else word() for w in base) for i in range(30)}
    docs |= {50: docs[3], 51: "", 52: None, 53: "a b"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.compare_with_next(df, count=48).collect()}
    order = sorted(docs, reverse=True)
    gaps = []
    for i, j in zip(order, [*order[1:], order[0]]):
        t, after = docs[i] or "", docs[j] or ""
        n = len(t) // 3
        new = t[: len(t) - n] + after[:n]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = (Counter(x.split()) for x in (t, new, after))
        for other, near in ((b, got[i].near_edited), (c, got[i].near_next)):
            union = sum((a | other).values())
            gaps.append(near - (sum((a & other).values()) / union if union else 1.0))
    assert got[50].fingerprint == got[3].fingerprint and got[51].fingerprint == got[52].fingerprint
    # Standard deviation of a share of 48 samples is at most 0.072.
    assert abs(np.mean(gaps)) < 0.03 and np.abs(gaps).max() < 0.3


def test_fingerprints_of_the_query(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op9_fingerprints"](spark, SMALL).collect()}
    order = sorted(texts, reverse=True)
    gaps = []
    for i, j in zip(order, [*order[1:], order[0]]):
        t, after = texts[i] or "", texts[j] or ""
        n = len(t) // 3
        a, b, c = (Counter(x.split()) for x in (t, t[: len(t) - n] + after[:n], after))
        for other, near in ((b, got[i].near_edited), (c, got[i].near_next)):
            union = sum((a | other).values())
            gaps.append(near - (sum((a & other).values()) / union if union else 1.0))
    assert all(len(r.fingerprint) >= 8 * 64 for r in got.values())
    # Standard deviation of a share of 64 samples is at most 0.0625.
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.0625 and np.abs(gaps).max() < 0.28


def test_fingerprints_leave_draws_out(spark):
    rnd = random.Random(5)
    words = lambda n, of: " ".join("w%d" % rnd.randrange(of) for _ in range(n))
    docs = [(i, words(n, of)) for i, (n, of) in enumerate([(1, 9), (9, 9), (300, 5), (300, 200), (2000, 9000), (40, 1)])]
    docs += [(10, ""), (11, " " * 90), (12, None), (None, "a b a")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    every = sorted(fingerprints.compare_with_next(df, count=16, cut=math.inf).collect(), key=str)
    for cut in (0.3, 2.0, fingerprints.CUT):
        assert sorted(fingerprints.compare_with_next(df, count=16, cut=cut).collect(), key=str) == every
    # Of 64 x 4,000 draws few are worth a logarithm and a row to aggregate.
    pair = spark.createDataFrame([(1, *[" ".join("w%d" % i for i in range(4000))] * 2)], "k long, a string, b string")
    terms = fingerprints.counted_terms(pair, ["k"], ("a", "b"), [])
    assert terms.count() == 4000 and fingerprints.candidates(terms, ["k"], []).count() < 64 * 4000 / 50


def test_weights(spark):
    df = spark.createDataFrame([("b a  b\nc b a",)], "t string")
    runs = df.select(F.explode(fingerprints._runs(F.sort_array(fingerprints.weighted_terms(F.col("t"))))).alias("x")).select("x.*")
    names = {spark.range(1).select(F.xxhash64(F.lit(w))).first()[0]: w for w in "abc"}
    assert {names[r.term]: r.weight for r in runs.collect()} == {"a": 2, "b": 3, "c": 1}


ODD = ["", None, "  a  b\n\tc ▁x  ", "ｆoo é 🙂", "<s>x</s>", "a\0b<0x0A>", "x" * 300 + "the" * 200, "...!!", "日本語 text", "x²y½ _a_"]


def test_pieces_as_the_library(spark, texts):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECE_BPE)
    rows = [*texts.items(), *[(10_000 + i, t) for i, t in enumerate(ODD)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in sentencepiece_lattice.encode_documents(df, PIECE_BPE, with_ids=True).collect():
        t = dict(rows)[r.doc_id] or ""
        assert r.ids == model.encode(t), t
        assert r.n_pieces == len(r.ids) and r.n_chars == len(t)
        assert r.round_trip == ("▁" not in t)


def test_viterbi_fold(spark):
    from tokenizers import Tokenizer, models

    rnd = random.Random(6)
    vocabulary = [("<unk>", 0.0), *[(c, -4.0 - i / 7) for i, c in enumerate("abcd")]]
    vocabulary += [(p, -rnd.random() * 9) for p in sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 5))) for _ in range(40)})]
    library = Tokenizer(models.Unigram(vocabulary, 0, False))
    rows = [(p, i, s) for i, (p, s) in enumerate(vocabulary) if i]
    pieces = sentencepiece_lattice.piece_table(rows, 0, [p.encode() for p, _ in vocabulary], "viterbi")
    units = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([(u,) for u in sorted(set(units))], "__unit string").repartition(4, "__unit")
    row = sentencepiece_lattice.RowFold(pieces)
    for r in sentencepiece_lattice.encode_units(df, pieces).collect():
        want = library.encode(r["__unit"]).ids
        score = lambda ids: sum(vocabulary[i][1] for i in ids)
        assert math.isclose(score(r["__ids"]), score(want), rel_tol=1e-9)
        assert "".join(vocabulary[i][0] for i in r["__ids"]) == r["__unit"]
        assert math.isclose(score(row.ids(r["__unit"])), score(want), rel_tol=1e-9)
