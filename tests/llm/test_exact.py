"""Operators with exact answers, against plain versions."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from roadweave.llm import decontam, host_rules, queries, secret_scan, simhash_dedup, token_count, token_store
from roadweave.llm.common import scratch

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three"), (None, "no id here at all, none"), (7, "Größe ÄÖ   wide"), (8, "x y " * 30000), (8, "x y " * 30000), (9, "日本語 テキスト <|endoftext|> it's 12")]


def odd(spark):
    return spark.createDataFrame([(i, t, "src", "en", 0, "a", 5) for i, t in ODD], "doc_id long, text string, source string, lang string, n_tokens int, fingerprint string, h int")


# --- near-duplicates ---------------------------------------------------------------------------
def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want_fp = [plain_fingerprint(r.text) for r in docs]
    want = plain_components([r.doc_id for r in docs], want_fp)
    got = {r.doc_id: r for r in queries.op3_simhash_near_duplicates(spark, SMALL).collect()}
    for r, fp, c in zip(docs, want_fp, want, strict=True):
        assert (got[r.doc_id].fingerprint, got[r.doc_id].component_id) == (f"{fp:016x}", c)


@pytest.mark.parametrize(("wide", "block"), [(False, 1024), (True, 1024), (False, 6)])
def test_links_of_crowded_fingerprints(spark, wide, block):
    r = random.Random(5)
    fps = set()
    for _ in range(40):
        base = r.getrandbits(64)
        for _ in range(12):
            x = base
            for b in r.sample(range(64), r.randrange(0, 8)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    want = plain_components(fps, fps)
    rows = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    got = {x.node: x.component for x in simhash_dedup.link_components(rows, wide=wide, block=block).collect()}
    groups: dict = {}
    for x, c in zip(fps, want, strict=True):
        groups.setdefault(c, set()).add(int(np.uint64(x).astype(np.int64)))
    found: dict = {}
    for n, c in got.items():
        found.setdefault(c, set()).add(n)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_any_four_positions_hold_a_group():
    from itertools import combinations

    for wide in (False, True):
        groups = [set(g) for g in simhash_dedup.position_groups(wide)]
        assert all(any(g <= set(four) for g in groups) for four in combinations(range(8), 4))


def test_simhash_cases(spark):
    rows = simhash_dedup.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert all(r.fingerprint == "0" * 16 for r in rows if r.doc_id in (1, 2, 3))
    kept = simhash_dedup.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 7, 8, 9]
    assert simhash_dedup.near_duplicates(odd(spark).where("false")).count() == 0


# --- token files -------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


def plain_tokens(tokenizer, rows):
    start, out = 0, {}
    for i, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_token_output_round_trip(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op4_token_output(spark, SMALL).collect()}
    assert got == plain_tokens(tokenizer, docs)


def test_token_output_over_many_shards(spark, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    path = scratch(spark, "shards")
    got = token_store.token_table(docs, queries.tokenizer_path("word_bpe_49k.json"), path, shard_bytes=20_000).collect()
    assert len({r.shard for r in got}) > 3
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == plain_tokens(tokenizer, [(r.doc_id, r.text) for r in docs.collect()])
    # one document by its place, from one file
    raw = bytes(spark.read.parquet(f"{path}/dictionary").first().bytes)
    some = next(r for r in got if r.at == 2)
    files = {int(re.search(r"part-(\d+)", r.path)[1]): bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").collect()}
    ids = token_store.read_document(files[some.shard][: -len(token_store.TAIL)], 2, raw)
    assert zlib.crc32(ids.astype("<u4").tobytes()) == some.ids_crc32
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.read_document(files[some.shard][: -len(token_store.TAIL)], 2, raw + b"x")


def test_token_output_cases(spark, tokenizer):
    rows = token_store.token_table(odd(spark), queries.tokenizer_path("word_bpe_49k.json")).collect()
    assert len(rows) == len(ODD)
    text = dict(ODD)
    for r in rows:
        ids = [*tokenizer.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert next(r.start for r in rows if r.doc_id is None) == 0
    assert token_store.token_table(odd(spark).where("false"), queries.tokenizer_path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_equals_the_library(special_as_text):
    """Odd and plain texts in any mixture, through caches that keep turning over."""
    import pyarrow as pa
    from roadweave.llm import encoding

    r = random.Random(1)
    odd_parts = ["a", "B", "É", "ß", "1", "_", "-", "'", "'s", " ", "\n", "\t", "\u00a0", "\x1c", "\u3000", "日本", "e\u0301", "İ", "Σ", "😀", "<|endoftext|>", "٣", "\u200b", "\u2028", "ǅ", "\u0085", "가"]
    plain_parts = ["a", "B", "É", "ß", "1", "2", "_", "-", "'", "'s", "'ll", " ", "  ", "\n", "\r", "\t", "xyz", "''", "<", ">", "|", "÷"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for parts in (odd_parts, plain_parts, plain_parts) for _ in range(4000)] + [None, "", "x" * 5000]
    r.shuffle(texts)
    enc = encoding.Encoder(queries.tokenizer_path("word_bpe_49k.json"), 2, special_as_text)
    assert enc.joins
    before, encoding._CACHE_PIECES = encoding._CACHE_PIECES, 1500
    try:
        for k in range(0, len(texts), 997):
            part = texts[k : k + 997]
            flat, ends = enc.closed(pa.array(part, pa.string()), 9)
            for t, ids in zip(part, np.split(flat, ends[:-1]), strict=True):
                assert ids.tolist() == [*enc._ids(t or ""), 9], t
    finally:
        encoding._CACHE_PIECES = before
    assert [len(x) for x in enc.encode(pa.array([], pa.string()))] == [0, 0]


def test_token_counts(spark, tokenizer):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in docs]
    path = scratch(spark, "flat")
    frame = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5)
    token_count.write_flat(frame, path, queries.tokenizer_path("word_bpe_49k.json"), 49407)
    names = {(r.file, r.doc_no): r.doc_id for r in token_count.read_names(spark, f"{path}/kind=docs").collect()}
    for block in (64, 4096, 4 << 20):
        rows = sorted(token_count.count_tokens(spark, f"{path}/kind=ids", 49407, block_bytes=block).collect(), key=lambda r: r.doc_seq)
        assert [r.doc_seq for r in rows] == list(range(len(want)))
        assert [n for _, n in sorted((names[r.file, r.doc_no], r.n_tokens) for r in rows)] == want
        assert len({r.file for r in rows}) == 5
        assert all(r.closed for r in rows)
    got = queries.op6_token_counts(spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == list(zip((i for i, _ in docs), want, strict=True))


def test_token_counts_without_a_last_separator(spark, tmp_path):
    np.array([5, 6, 9, 7, 9, 9, 1, 2, 3, 4], "<u4").tofile(tmp_path / "part-0")
    for block in (4, 8, 400):
        rows = sorted(token_count.count_tokens(spark, f"file://{tmp_path}", 9, block_bytes=block, id_bytes=4).collect(), key=lambda r: r.doc_seq)
        assert [(r.n_tokens, r.closed) for r in rows] == [(2, True), (1, True), (0, True), (4, False)]


def test_token_counts_cases(spark):
    rows = token_count.flat_token_counts(odd(spark), queries.tokenizer_path("word_bpe_49k.json"), 49407).collect()
    assert len(rows) == len(ODD)
    assert sum(r.n_tokens == 0 for r in rows) == 3
    assert sorted((r.doc_id or 0) for r in rows) == sorted(i or 0 for i, _ in ODD)
    assert token_count.flat_token_counts(odd(spark).where("false"), queries.tokenizer_path("word_bpe_49k.json"), 49407).count() == 0


# --- decontamination ---------------------------------------------------------------------------
def plain_leaks(docs, items):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    from collections import Counter

    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    bench = {i: shingles(cut(t)) for i, t in items}
    out = {}
    for d, t in docs:
        s = shingles(cut(t))
        for i, b in bench.items():
            n = min(len(b), len(s))
            if not n or not set(s) & set(b):
                continue
            want, best = Counter(b), 0.0
            for k in range(len(s) - n + 1):
                common = sum((Counter(s[k : k + n]) & want).values())
                best = max(best, common / (n + len(b) - common))
            if best >= 0.8 - 1e-12:
                out[d, i] = round(best, 6)
    return out


@pytest.mark.parametrize("set_limit", [20_000, 0])
def test_decontamination_matches_brute_force(spark, set_limit):
    r = random.Random(3)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for k in range(60):  # passages with some words changed, cut short, or alone
        i, t = r.choice(items)
        w = t.split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "changed"
        docs.append((10_000 + k, " ".join(["before it"] * r.randrange(5) + w[r.randrange(4) :] + ["after it"] * r.randrange(5))))
    docs.append((20_000, items[0][1] + " " + items[0][1].upper()))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontam.find_leaks(frame, bench, set_limit=set_limit).collect()}
    assert got == plain_leaks(docs, items)
    left = {x.doc_id for x in decontam.drop_leaks(frame, bench, set_limit=set_limit).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}


def test_decontamination_cases(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta", 3), (2, None, 3), (3, "too short", 3), (1, "alpha beta gamma delta epsilon zeta eta", 3)], "item_id long, text string, n int")
    docs = odd(spark).select("doc_id", "text", "h").union(spark.createDataFrame([(None, "so alpha beta gamma delta epsilon zeta eta", 1)], "doc_id long, text string, h int"))
    rows = decontam.find_leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(None, 1)}
    assert decontam.find_leaks(docs.where("false"), items).count() == 0
    assert decontam.find_leaks(docs, items.where("false")).count() == 0
    assert decontam.drop_leaks(docs, items).count() == docs.count() - 1


# --- host rules --------------------------------------------------------------------------------
def plain_counts(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen: dict = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in host_rules.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_host_rules_counts(spark):
    texts = [t for _, t in ODD] + ["a b c d e f a b c d e", "a a a a a a a", "x\nx\n \nx", "##$ | <b>"]
    docs = spark.createDataFrame([(i, t, None if i % 3 == 0 else "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    rows = {r.doc_id: r for r in host_rules.host_verdicts(docs).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert host_rules.host_verdicts(docs.where("false")).count() == 0


def test_bad_hosts_lose_their_documents(spark):
    good = "this is one of many texts with more than ten different words number"
    rows = [(i, f"{good} {i}" if i % 20 else "short", f"h{i % 5}") for i in range(400)] + [(1000 + i, "bad" if i % 8 else f"{good} {i}", "spam") for i in range(80)] + [(5000, f"{good} again", "tiny")]
    got = {r.doc_id: r for r in host_rules.host_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[1000].kept and not got[1000].base_failed
    assert got[1].kept and got[5000].kept


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in out.description]
    at = [names.index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in out.fetchall())


# --- secrets -----------------------------------------------------------------------------------
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(a, e, secret_scan.BASE_KINDS[k]) for a, k, e in sorted(out)]


def test_secret_spans_match_regular_expressions():
    r = random.Random(9)
    parts = ["token", "Secret", "password", "passwd", "api_key", "apikey", "AKIA", "AKI", "=", ":", " ", '"', "'", "a1b2c3", "deadbeef", "0123456789", "XYZ9", "é", ".", "\n", "z", "ABCDEFGH", "😀"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert [x for x in secret_scan.find_secrets(t) if x[2] in secret_scan.BASE_KINDS] == plain_secrets(t)


def test_secret_scan_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op10_secret_scan(spark, DATA).collect():
        want = plain_secrets(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, _, x in want) for k in secret_scan.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, e, k in want).encode()).hexdigest()


def test_secret_scan_cases(spark):
    rows = secret_scan.scan_secrets(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert {r.spans for r in rows} == {""}
    key = "-----BEGIN RSA PRIVATE KEY-----"
    assert secret_scan.find_secrets(f"ü {key} ghp_" + "a1" * 20) [0][:2] == (2, 2 + len(key))
    assert secret_scan.scan_secrets(odd(spark).where("false")).count() == 0
