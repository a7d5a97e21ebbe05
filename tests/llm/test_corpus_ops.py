"""Corpus operators: SQL where it can tell, brute force where it can't, and the awkward inputs."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbitlake.llm import common, fingerprint, language_id, line_dedup, mtree, packing, registry, repair, secret_scan, simhash, source_mix, warc
from orbitlake.llm.components import components, forest
from orbitlake.llm.text import Column

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], SCHEMA)


LONG = "The quick brown fox number {} jumps over the lazy dog and runs away from every hunter in the wood.\n"
WEIRD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s1"),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "s1"),  # a repeated row
    (2, None, "en", "s1"),
    (3, "", None, None),
    (4, " \n\t\n ", "en", "s2"),
    (5, "!!! ??? ...", "de", "s2"),
    (None, "no identifier here but words enough to be a document", "en", None),
    (6, "".join(LONG.format(k) for k in range(3000)), "en", "s1"),
    (7, "x", "en", "s3"),
    (8, "日本語 текст ñandú", "es", "s1"),
]


@pytest.fixture(scope="module")
def weird(spark):
    return docs_of(spark, WEIRD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(weird):
    """Extra columns whose names the operators use themselves, and one that differs only in case."""
    names = ["copy_no", "k1", "h", "n", "kept", "source_", "rate", "bucket", "score", "TEXT2"]
    return weird.withColumns({c: F.lit(9) for c in names})


DOC_OPS = {
    "scan": secret_scan.scan,
    "fingerprint": fingerprint.fingerprint_documents,
    "mix": source_mix.mix_sources,
    "language": language_id.identify,
    "keep": language_id.keep_identified,
    "lines": line_dedup.dedup_lines,
    "repair": repair.encode_documents,
    "near": simhash.near_duplicates,
    "drop": simhash.drop_near_duplicates,
    "pack": packing.pack,
}


@pytest.mark.parametrize("name", sorted(DOC_OPS))
def test_awkward_inputs(name, weird, empty, clashing):
    op = DOC_OPS[name]
    assert op(empty).count() == 0
    plain = op(weird)
    extra = op(clashing)
    assert plain.count() == extra.count()
    if name in ("keep", "lines", "drop"):
        assert extra.columns == clashing.columns and plain.columns == weird.columns


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(name, spark, small, same_as_sql):
    same_as_sql(registry.QUERIES[name](spark, small), registry.SQL[name], small)


# --- 1 secret scans


def test_trigram_queries_are_sound():
    data = [("-----BEGIN RSA PRIVATE KEY-----", "private_key"), ('Token = "abcdefgh1"', "assigned_token"), ("AKIA" + "A1" * 8, "aws_access_key"), ("ghp_" + "a" * 36, "github_token"), ("https://u:p@h", "url_credentials")]
    for text, rule in data:
        pattern, ignore = secret_scan.RULES[rule]
        assert re.search(pattern, text, re.A | (re.I if ignore else 0))
        col = Column(pa.array(["nothing", text, None, ""]))
        query = secret_scan.trigram_query(pattern, ignore)
        assert query is not None
        words = sorted(secret_scan._vocabulary(query))
        table = np.zeros(1 << 24, np.uint16)
        table[words] = np.arange(1, len(words) + 1)
        assert secret_scan.candidates(query, secret_scan.index_segment(col.data, col.offsets, words, table)).tolist() == [1]
    assert secret_scan.trigram_query(r"[a-z]+") is None and secret_scan.trigram_query("ab|abcd") is None
    assert secret_scan.trigram_query(r"(?:abc)?d") is None or secret_scan._vocabulary(secret_scan.trigram_query(r"(?:abc)?d")) == set()


def test_scan_equals_full_scan(spark):
    rows = docs_of(spark, [(k, f'say token="{"x" * k}" AKIA{"Z" * 16} {hashlib.sha1(b"a").hexdigest()} 4111111111111111 é', "en", "s") for k in range(5, 12)] + [(99, None, "en", "s")])
    want = []
    for r in rows.collect():
        for rule, (p, i) in secret_scan.RULES.items():
            want += [(r.doc_id, rule, m.start(), m.end() - m.start(), hashlib.sha256(m.group().encode()).hexdigest()) for m in re.finditer(p, r.text or "", re.A | (re.I if i else 0))]
    assert sorted(tuple(r) for r in secret_scan.scan(rows).collect()) == sorted(want)


# --- 2 fingerprints


def test_extensions_and_spans(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(200):
        a, b = ("".join(rng.choice(list("ab日"), rng.integers(0, 40))) for _ in range(2))
        i, j = int(rng.integers(0, len(a) + 1)), int(rng.integers(0, len(b) + 1))
        f = next((n for n in range(99) if i + n >= len(a) or j + n >= len(b) or a[i + n] != b[j + n]))
        g = next((n for n in range(99) if i - n <= 0 or j - n <= 0 or a[i - n - 1] != b[j - n - 1]))
        n = int(rng.integers(0, 3))
        rows.append((k, a, i, b, j, n))
        want[k] = (f, g, i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
    df = spark.createDataFrame(rows, "id int, a string, i int, b string, j int, length int")
    ext = {r.id: (r.forward, r.backward) for r in fingerprint.common_extension(df).collect()}
    eq = {r.id: r.equal for r in fingerprint.span_equal(df).collect()}
    assert {k: (*ext[k], eq[k]) for k in want} == want
    bad = spark.createDataFrame([(1, "abc", 4, "abc", 0, 1), (2, None, 0, "a", 0, 1), (3, "abc", 2, "abc", 0, 2)], df.schema)
    assert {r.id: r.forward for r in fingerprint.common_extension(bad).collect()} == {1: None, 2: None, 3: 0}
    assert {r.id: r.equal for r in fingerprint.span_equal(bad).collect()} == {1: False, 2: None, 3: False}


def test_longest_shared_prefix_and_suffix_of_all(spark):
    rng = np.random.default_rng(21)
    texts = ["", "", None]
    for _ in range(60):  # prefixes, suffixes and both of earlier texts, up to some thousand characters
        other = texts[int(rng.integers(0, len(texts)))] or ""
        own = "".join(rng.choice(list("abc日"), int(rng.choice([0, 1, 5, 40, 900]))))
        at = int(rng.integers(0, len(other) + 1))
        texts.append([other[:at] + own, own + other[at:], other + own, other][int(rng.integers(0, 4))][:4000])
    docs = docs_of(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]).repartition(5)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for r in fingerprint.fingerprint_documents(docs).collect():
        text = texts[r.doc_id]
        if text is None:
            assert (r.n_chars, r.exact_of, r.prefix_common, r.suffix_with) == (None,) * 4
            continue
        others = [t for t in texts if t is not None and t != text]
        assert r.exact_of == texts.index(text) and r.n_chars == len(text)
        for found, who, back in ((r.prefix_common, r.prefix_with, 1), (r.suffix_common, r.suffix_with, -1)):
            assert found == max(common(text[::back], t[::back]) for t in others)
            assert who is None if found == 0 else texts[who] != text and common(text[::back], texts[who][::back]) == found


# --- 3 mixing


def test_mix_reaches_weights(spark):
    rows = docs_of(spark, [(k, "a b c d", "en", "big" if k % 4 else "small") for k in range(4000)])
    got = source_mix.mix_sources(rows, {"big": 1.0, "small": 1.0}).groupBy("source").agg(F.sum(source_mix.n_tokens(F.col("text"))).alias("t")).collect()
    for r in got:
        assert r.t == pytest.approx(8000, rel=0.06)
    per = {r.doc_id: r.n for r in source_mix.mix_sources(rows, {"big": 1.0, "small": 1.0}).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {per.get(k, 0) for k in range(0, 4000, 4)} == {2} and {per.get(k, 0) for k in range(1, 4000, 4)} == {0, 1}


def test_mix_replaces_the_column_in_any_case(spark, weird, tmp_path):
    for name in ("copy_no", "COPY_NO"):
        out = source_mix.mix_sources(weird.withColumn(name, F.lit("x")))
        assert out.columns == [*weird.columns, "copy_no"] and out.schema["copy_no"].dataType.typeName() == "integer"
        out.write.parquet(str(tmp_path / name))
    kept = weird.withColumn("COPY_NO", F.lit("x"))
    assert source_mix.repeat_documents(kept).columns == kept.columns


# --- 4 language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    model = language_id.fit(train)
    got = language_id.identify(test, model).join(test.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.predicted == r.lang for r in got) / len(got) > 0.97
    assert sum(r.predicted is None for r in got) / len(got) < 0.02
    junk = docs_of(spark, [(1, "1234 5678 ### $$$", "en", "s"), (2, "щфывапролджэ йцукенгшщз хъфывапр", "xx", "s"), (3, "的一是不了人我在有他这为之大来以个中上们", "xx", "s")])
    assert all(r.predicted is None for r in language_id.identify(junk, model).collect())
    assert [r.predicted for r in language_id.identify(test.limit(3), language_id.fit(junk.withColumn("lang", F.lit(None).cast("string")))).collect()] == [None] * 3


def test_language_against_plain_python(spark, weird):
    """TF-IDF and cosines document by document with dictionaries."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(weird.withColumn("doc_id", F.col("doc_id") + 10**6))
    texts = {r.doc_id: r.text for r in docs.collect()}

    def grams(text):
        raw = text.encode()
        low = bytearray(b" " + raw.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) + b" ")
        for i in range(1, len(low)):
            if low[i - 1] == 0xC3 and 0x80 <= low[i] <= 0x9E and low[i] != 0x97:
                low[i] += 32
        low = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in low)
        out = Counter()
        for i in range(1, len(low) - 1):
            if low[i] != 32:
                code = (low[i - 1] << 16 | low[i] << 8 | low[i + 1]) * 2654435761 % 2**32
                code = (code ^ code >> 15) * 2246822519 % 2**32
                out[code >> 20] += 1
        return out

    counted = [grams(r.text or "") for r in docs.collect()]
    df = Counter(b for c in counted for b in c)
    model = language_id.fit(docs)
    idf = {b: np.log((1 + len(counted)) / (1 + n)) + 1 for b, n in df.items()}
    assert np.allclose([model.idf[b] for b in idf], list(idf.values()))
    for r in language_id.identify(docs, model).collect():
        tf = grams(texts[r.doc_id] or "")
        n = sum(tf.values())
        v = {b: np.log1p(k) * idf[b] for b, k in tf.items()}
        norm = sum(w * w for w in v.values()) ** 0.5 or 1
        cos = [sum(w * c[b] for b, w in v.items()) / norm for c in model.centroids]
        score = max(cos) / (model.a * (n / (n + model.c)) ** 0.5) if n else 0.0
        few, many = language_id.FEW, language_id.MANY
        limit = language_id.ACCEPT + (model.strict - language_id.ACCEPT) * min(max((len(tf) - few) / (many - few), 0), 1)
        assert abs(r.score - score) < 1e-4
        if abs(score - limit) > 1e-4:
            assert r.predicted == (model.languages[int(np.argmax(cos))] if score >= limit else None)


@pytest.mark.parametrize("words", [200, 1_000, 5_000])
def test_language_rejects_junk_of_any_length(spark, words):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    rng = np.random.default_rng(words)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    junk = docs_of(spark, [(k, " ".join("".join(rng.choice(letters, n)) for n in rng.integers(2, 11, words)), "en", "s") for k in range(10)])
    assert [r.doc_id for r in language_id.identify(junk, model).collect() if r.predicted] == []
    assert language_id.keep_identified(junk, model).count() == 0


def test_language_keeps_short_and_repetitive_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter("doc_id % 2 = 0"))
    held = [(r.doc_id, " ".join([w for w in r.text.split() if w.strip(".,").isalpha()][:8]), r.lang, "s") for r in docs.filter("doc_id % 2 = 1").collect()]
    short = docs_of(spark, [r for r in held if len(r[1]) > 25])
    got = language_id.identify(short, model).join(short.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 300 and sum(r.predicted is None for r in got) <= 0.01 * len(got) and sum(r.predicted == r.lang for r in got) >= 0.95 * len(got)
    again = docs_of(spark, [(1, "Eran. " * 2_000, "en", "s"), (2, "Das " * 2_000, "de", "s"), (3, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" From reha reenti oution thti.', "en", "s"), (4, 'Thingeaor. Ndwhou edwhes token = "9004e046e75240f42eecdbd3dffbc7f3d75db0ff" in erthedble on ingoution thndnt and.', "en", "s")])
    assert all(r.predicted for r in language_id.identify(again, model).collect())


# --- 5 WARC


def test_warc_faults(spark, tmp_path):
    good = warc.record(1, "http://a/%20 b\nc", "<p>é</p>" * 50_000)
    import gzip

    wrong = gzip.compress(gzip.decompress(warc.record(2, "u", "abc")).replace(b"abc", b"abd"))
    short = gzip.compress(gzip.decompress(warc.record(3, "u", "abc"))[:-6])
    plain = gzip.compress(b"hello\r\n\r\n")
    bare = gzip.compress(b"WARC/1.0\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(good + wrong + short + plain + bare + warc.record(4, None, None) + good[:100])
    (tmp_path / "b.warc.gz").write_bytes(b"not gzip at all")
    (tmp_path / "c.warc.gz").write_bytes(b"")
    files = spark.createDataFrame([(str(p),) for p in sorted(tmp_path.iterdir())] + [(None,)], "path string")
    rows = warc.read_warc(files).collect()
    got = [(r.page_id, r.status) for r in rows]
    assert got[:6] == [(1, "ok"), (2, "digest mismatch"), (3, "bad length"), (None, "bad header"), (None, "no digest"), (4, "ok")]
    assert [s for _, s in got[6:]] == ["truncated", "truncated"]
    assert rows[0].url == "http://a/%20 b\nc" and rows[0].html == "<p>é</p>" * 50_000 and rows[5].html is None and rows[5].url is None


def test_warc_goes_on_after_damage(spark, tmp_path):
    parts = [warc.record(k, f"http://a/{k}", "text %d " % k * 20_000 * (k % 3)) for k in range(12)]
    for k in (1, 4, 5):
        at = len(parts[k]) // 2
        parts[k] = parts[k][:at] + bytes([parts[k][at] ^ 0x55]) + parts[k][at + 1 :]
    parts[8] = parts[8][: len(parts[8]) // 2]  # a writer that died and was started again
    parts[10] = parts[10][:-6] + b"zz" + parts[10][-4:]  # a wrong check sum
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    for size in (64, warc.READ_BYTES):
        with open(tmp_path / "a.warc.gz", "rb") as f:
            got = [(r.row(c)[0], r.status(c)) for r, c in warc.records(f, size)]
        assert [p for p, s in got if s == "ok"] == [0, 2, 3, 6, 7, 9, 11]
        assert len(got) == 12 and sum(s == "truncated" for _, s in got) == 5


def test_warc_urls_stand_as_they_are(spark, tmp_path):
    import gzip

    foreign = b"WARC/1.0\r\nWARC-Target-URI: http://a/b%20c?q=100%25\r\nContent-Length: 2\r\nX-Fold: a\r\n b\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(foreign))
    assert warc.read_warc(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string")).first().url == "http://a/b%20c?q=100%25"
    urls = ["\thttp://a", " x ", "a\r\nX-Page-Id: 7", "", "%0A", "ü\u2028ñ", "http://a/b%20c d"]
    pages = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id bigint, url string, html string")
    assert {r.page_id: r.url for r in warc.round_trip(pages).collect()} == dict(enumerate(urls))


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "u", "<p>"), (None, None, None), (1, "u", "<p>"), (2, "v", "")], "page_id bigint, url string, html string").withColumn("status", F.lit("x"))
    got = sorted(((r.page_id, r.url, r.html, r.status) for r in warc.round_trip(pages).collect()), key=repr)
    assert got == sorted([(1, "u", "<p>", "ok"), (1, "u", "<p>", "ok"), (None, None, None, "ok"), (2, "v", "", "ok")], key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


# --- 6 lines


def brute_lines(rows):
    """Kept lines by document from all pairs of lines that share a band, and the share of the similar pairs that do."""
    first = {}
    for i, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line, (i is None, i or 0, no))
                first[line] = min(first[line], (i is None, i or 0, no))
    lines = sorted(first)
    sets = [{s[i : i + line_dedup.SHINGLE] for i in range(max(len(s) - line_dedup.SHINGLE + 1, 1))} for s in lines]
    order = sorted(range(len(lines)), key=lambda x: len(sets[x]))
    a, b = [], []
    for at, x in enumerate(order):
        for y in order[at + 1 :]:
            if len(sets[x]) < line_dedup.THRESHOLD * len(sets[y]) - 1e-9:
                break
            shared = len(sets[x] & sets[y])
            if shared >= line_dedup.THRESHOLD * (len(sets[x]) + len(sets[y]) - shared) - 1e-9:
                a.append(x)
                b.append(y)
    col = Column(pa.array(lines))
    keys = line_dedup.signatures(col.data, col.offsets)
    a, b = np.array(a, dtype=int), np.array(b, dtype=int)
    met = (keys[a] == keys[b]).any(axis=1)
    root = forest(len(lines), a[met], b[met])
    owner = {}
    for x, line in enumerate(lines):
        owner[root[x]] = min(owner.get(root[x], first[line]), first[line])
    return set(owner.values()), met.mean()


def test_lines_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    keep, met = brute_lines(rows)
    want = {}
    for i, t in rows:
        left = [line for no, line in enumerate(t.split("\n")) if (False, i, no) in keep]
        if left:
            want[i] = left
    assert met >= 0.95
    assert {r.doc_id: [x for x in r.text.split("\n") if x.strip()] for r in line_dedup.dedup_lines(docs).collect()} == want


def test_buckets_of_several_groups(spark):
    """Lines of one band but different components, more of them than star steps."""
    rng = np.random.default_rng(61)
    letters, groups = list("abcdefghijklmnopqrstuvwxyz "), 3 * line_dedup.STARS
    shared = "".join(rng.choice(letters, 90))
    rows = [(10 * g + c, shared + "".join(rng.choice(letters, 40)) + "xyzw"[:c], "en", "s") for g in range(groups) for c in range(4)]
    rows = [(i, t if i % 10 == 0 else rows[4 * (i // 10)][1] + "xyzw"[: i % 10], *r) for i, t, *r in rows]
    keep, _ = brute_lines([r[:2] for r in rows])
    got = {r.doc_id for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == {i for _, i, _ in keep} and len(got) >= groups


@pytest.mark.parametrize("easy", [0, 1_000])
def test_pairs_of_buckets_are_no_table(spark, monkeypatch, easy):
    """Variants of a template that aren't similar enough: pairs grow with the square of them, tables don't."""
    monkeypatch.setattr(line_dedup, "EASY", easy)
    monkeypatch.setattr(line_dedup, "PART_ROWS", 50)  # so that buckets are compared in tiles
    verify, given = line_dedup.verify, []
    monkeypatch.setattr(line_dedup, "verify", lambda pairs, text: given.append(pairs.count()) or verify(pairs, text))
    rng = np.random.default_rng(63)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    shared = "".join(rng.choice(letters, 90))
    lines = [shared + "".join(rng.choice(letters, 25)) for _ in range(250)]
    rows = [(i, x, "en", "s") for i, x in enumerate([*lines, *[x + "xyz" for x in lines[200:]]])]
    keep, _ = brute_lines([r[:2] for r in rows])
    assert {r.doc_id for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()} == {i for _, i, _ in keep}
    assert 200 < len(keep) < len(rows) - 40 and max(given) <= line_dedup.BANDS * len(rows)
    assert len(given) == 1 if easy else len(given) > 1  # few pairs a line: no further star


def test_lines_chains_and_ties(spark):
    base = "this line of text is repeated in many documents with some small changes "
    chain = [base + "abcdefghijklmnop"[:k] for k in range(10, 16)]  # neighbours are similar, ends less so
    rows = docs_of(spark, [(k, chain[k] + "\n\nown line of document number %d %s" % (k, "qwertz"[k] * 9), "en", "s") for k in range(6)] + [(7, chain[0], "en", "s"), (8, "", "en", "s"), (9, None, "en", "s")])
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(rows).collect()}
    assert got[0] == chain[0] + "\n\nown line of document number 0 qqqqqqqqq"
    assert all(got[k].startswith("own line") for k in range(1, 6)) and 7 not in got and got[8] == "" and got[9] is None


def test_repeated_rows_keep_their_lines_once(spark):
    rows = docs_of(spark, [(1, "one line that repeats", "en", "s")] * 3)
    assert [r.text for r in line_dedup.dedup_lines(rows).collect()] == ["one line that repeats"]


def test_lines_without_broadcasts(spark, monkeypatch):
    """As on large tables: texts of documents are shuffled once, and tables of lines go before the result is computed."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    start = common.mark(spark)
    out = line_dedup.dedup_lines(docs)
    columns = {c for path in common._made[spark.sparkContext.applicationId][start:] for c in spark.read.parquet(path).columns}
    assert "line" not in columns and "kept" in columns
    got = [(r.doc_id, x) for r in out.collect() for x in r.text.split("\n") if x.strip()]
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")]
    assert len(re.findall(r" Exchange hashpartitioning\(k1", final)) <= 2  # of the documents and of their fates
    keep, _ = brute_lines(rows)
    first = {i: t.split("\n") for i, t in rows}
    assert sorted(got) == sorted((i, first[i][no]) for _, i, no in keep)


def test_sieve_holds_every_key(spark):
    keys = np.random.default_rng(62).integers(-(1 << 63), (1 << 63) - 1, 5_000)
    bits = common.sieve(spark.createDataFrame([(int(k),) for k in keys[:2_500]], "h bigint"))
    assert common.sifted(bits, keys[:2_500]).all() and common.sifted(bits, keys[2_500:]).mean() < 0.15


# --- 7 Re-Pair


@pytest.mark.parametrize("shard", [20_000, repair.SHARD_TOKENS])
def test_repair_round_trip(spark, weird, shard):
    enc, base = repair.encoder(repair.VOCABULARY)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(weird.filter("doc_id > 1").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    coded = repair.encode_documents(docs, shard_tokens=shard).cache()
    want = {r.doc_id: r.text for r in docs.collect()}
    full = {r.doc_id: r.ids for r in repair.decode_documents(coded).collect()}
    assert all(full[i] is None if t is None else full[i] == enc.encode_ordinary(t) for i, t in want.items())
    part = {r.doc_id: r.ids for r in repair.decode_documents(coded, 7, 11).collect()}
    assert all(full[i] is None or part[i] == full[i][7:18] for i in want)
    size = coded.agg(F.sum(F.length("symbols"))).first()[0]
    assert size < 1.5 * sum(len(v) for v in full.values() if v)
    for r in coded.filter("kind = 'rules'").collect():
        pairs = repair.unpack(r.symbols, r.width).reshape(-1, 2)
        assert len(pairs) == r.n_ids and (pairs < base + np.arange(len(pairs))[:, None]).all()
        assert (repair.unpack(r.lengths, r.length_width) == repair.expansion_lengths(pairs, base)).all()


def plain_repair(rows):
    """Symbols and rules left by replacing the most frequent pair, one at a time, until none occurs twice."""
    rows, rules, new = [list(r) for r in rows], 0, 10**6
    while True:
        count = Counter()
        for r in rows:
            i = 0
            while i < len(r) - 1:
                count[r[i], r[i + 1]] += 1
                i += 2 if i < len(r) - 2 and r[i] == r[i + 1] == r[i + 2] else 1
        pair, n = max(count.items(), key=lambda x: x[1], default=(None, 0))
        if n < 2:
            return sum(map(len, rows)), rules
        rules, new = rules + 1, new + 1
        for k, r in enumerate(rows):
            out, i = [], 0
            while i < len(r):
                hit = tuple(r[i : i + 2]) == pair
                out.append(new if hit else r[i])
                i += 2 if hit else 1
            rows[k] = out


def test_grammar_against_plain_repair():
    rng = np.random.default_rng(7)
    phrases = [list(rng.integers(0, 40, n)) for n in rng.integers(2, 12, 40)]
    rows = [[int(s) for p in np.minimum(rng.geometric(0.08, 30), 40) for s in phrases[p - 1]] for _ in range(40)]
    ids, counts = np.concatenate([np.array(r) for r in rows]), np.array([len(r) for r in rows])
    symbols, per, pairs = repair.compress(ids, counts, 40)
    want, rules = plain_repair(rows)
    assert len(symbols) + 2 * len(pairs) <= 1.1 * (want + 2 * rules)
    ends = np.cumsum(per)
    left = Counter((a, b) for e, p in zip(ends, per) for a, b in zip(symbols[e - p : e - 1].tolist(), symbols[e - p + 1 : e].tolist()) if a != b)
    assert max(left.values(), default=0) < 2


def test_rare_pairs_are_not_counted_each_round(monkeypatch):
    """Places whose pair is rarer than the limit wait; pairs that share a slot in one round don't in the next."""
    monkeypatch.setattr(repair, "_SLOTS", 1 << 14)
    slot, counted = repair._slot, []
    monkeypatch.setattr(repair, "_slot", lambda a, b, *turn: counted.append(len(a)) or slot(a, b, *turn))
    ids = np.random.default_rng(71).zipf(1.2, 60_000) % 5_000
    symbols, per, pairs = repair.compress(ids, np.array([len(ids)]), 5_000)
    lengths = repair.expansion_lengths(pairs, 5_000)
    assert repair.decode(symbols, pairs, lengths, 5_000) == ids.tolist()
    code = symbols[:-1] << 32 | symbols[1:]
    _, n = np.unique(code[symbols[:-1] != symbols[1:]], return_counts=True)
    assert n.max() == 1 and sum(counted) < 8 * len(ids)


def test_compress_runs_and_borders():
    for ids, counts in (([5] * 9, [9]), ([1, 2, 1, 2, 1, 2], [3, 3]), ([1], [1]), ([], []), ([1, 1, 1, 2, 2, 2, 1, 1], [4, 4])):
        symbols, per, pairs = repair.compress(np.array(ids), np.array(counts, dtype=int), 10, least=2)
        lengths, at, out = repair.expansion_lengths(pairs, 10), 0, []
        for n in per:
            out.append(repair.decode(symbols[at : at + n], pairs, lengths, 10))
            at += n
        ends = np.cumsum(counts)
        assert out == [list(ids[e - c : e]) for e, c in zip(ends, counts)]


# --- 8 SimHash


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t = simhash.fingerprint_table(docs).toPandas()
    h = [t[c].to_numpy().astype("i8").view("u8") for c in ("h0", "h1")]
    d = sum(np.bitwise_count(x[:, None] ^ x[None, :]).astype(int) for x in h)
    m = t["m"].to_numpy().astype("i8").view("u8")
    root = forest(len(t), *np.nonzero((d <= simhash.RADIUS) & (np.bitwise_count(m[:, None] ^ m[None, :]) <= simhash.SKETCH)))
    groups = {}
    for i, r in zip(t.doc_id, root):
        groups.setdefault(r, []).append(i)
    want = {i: min(g) for g in groups.values() for i in g}
    for tile in (16, simhash.TILE):
        got = simhash.near_duplicates(docs, tile=tile).collect()
        assert {r.doc_id: r.group_id for r in got} == want and all(r.kept == (r.doc_id == r.group_id) for r in got)


def test_parts_of_fingerprints_lose_no_pair(spark):
    rng = np.random.default_rng(82)
    seeds = rng.integers(0, 1 << 63, (2, 300), dtype=np.uint64)
    h = np.repeat(seeds, 6, axis=1)
    for c in range(h.shape[1]):  # up to 30 bits changed, spread as evenly over the parts as they can be, or at random
        bits = rng.permutation(np.arange(128).reshape(8, 16).T.ravel()[: 8 * rng.integers(1, 16)] if c % 2 else 128)[: rng.integers(0, 31)]
        for b in bits.tolist():
            h[b // 64, c] ^= np.uint64(1 << (b % 64))
    side = (h[0], h[1], rng.integers(0, 1 << 63, h.shape[1], dtype=np.uint64), np.bitwise_count(h[0]).astype(int) + np.bitwise_count(h[1]))
    order = np.argsort(side[3], kind="stable")
    side = tuple(c[order] for c in side)
    for left, right in ((side, None), (tuple(c[:700] for c in side), tuple(c[700:] for c in side))):
        want = {(i, j): s for i, j, s in zip(*(x.tolist() for x in simhash.compare(left, right, simhash.RADIUS)))}
        for shares in (1, 4):
            runs = [simhash.compare_parts(left, right, simhash.RADIUS, [k], n, shares) for k in range(8) for n in range(shares)]
            found = [((min(i, j), max(i, j)) if right is None else (i, j), s) for r in runs for i, j, s in zip(*(x.tolist() for x in r))]
            assert len(found) == len(want) > 300 and dict(found) == want
        whole = simhash.compare_parts(left, right, simhash.RADIUS, range(8))
        assert len(whole[0]) == len(want)


def test_near_duplicates_by_parts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: (r.group_id, r.kept) for r in simhash.near_duplicates(docs).collect()}
    for tile in (16, simhash.TILE):
        assert {r.doc_id: (r.group_id, r.kept) for r in simhash.near_duplicates(docs, tile=tile, dense=0).collect()} == want


def test_pairs_that_the_sketch_denies(spark):
    """Expected groups from bit differences and word counts in plain Python: no sketch."""
    rng = np.random.default_rng(80)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    texts = []
    for _ in range(40):  # a long repetitive text and its copy with a short tail of new words
        line = " ".join(rng.choice(vocabulary, 8))
        texts += [" ".join([line] * 60), " ".join([line] * 60) + " " + " ".join(rng.choice(vocabulary, 20))]
    for _ in range(150):  # one long text, whose copy has many words changed
        body = list(rng.choice(vocabulary, 40)) * 4
        texts += [" ".join(body), " ".join(body + list(rng.choice(vocabulary, 20)))]
    line = " ".join(rng.choice(vocabulary, 8))
    texts += [line + " " + " ".join(rng.choice(vocabulary, 12)) for _ in range(60)]  # short, with a line in common
    docs = docs_of(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    t = simhash.fingerprint_table(docs).toPandas().sort_values("doc_id")
    h = [t[c].to_numpy().astype("i8").view("u8") for c in ("h0", "h1")]
    d = sum(np.bitwise_count(x[:, None] ^ x[None, :]).astype(int) for x in h)
    sets, bags = [set(x.split()) for x in texts], [Counter(x.split()) for x in texts]
    a, b = np.nonzero(np.triu(d <= simhash.RADIUS, 1))
    near = [len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]) or (bags[i] & bags[j]).total() >= 0.5 * (bags[i] | bags[j]).total() for i, j in zip(a, b)]
    m = t["m"].to_numpy().astype("i8").view("u8")
    assert (np.bitwise_count(m[a] ^ m[b]) > simhash.SKETCH)[near].any()
    root = forest(len(texts), a[near], b[near])
    for tile in (32, simhash.TILE):
        assert {r.doc_id: r.group_id for r in simhash.near_duplicates(docs, tile=tile).collect()} == dict(enumerate(root))


def test_equal_fingerprints_of_different_words_stay_apart(spark):
    rng = np.random.default_rng(81)
    tails = [" ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(40)) for _ in range(3)]
    docs = docs_of(spark, [(k, "spam " * 60 + t, "en", "s") for k, t in enumerate([*tails, tails[0]])])
    assert simhash.fingerprint_table(docs).select("h0", "h1").distinct().count() == 1
    assert {r.doc_id: r.group_id for r in simhash.near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 0}


def test_near_copies_found_and_clean_kept(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    rows, copies = [], set()
    for k in range(60):
        words = list(rng.choice(vocabulary, 120))
        rows.append((10 * k, " ".join(words), "en", "s"))
        for c in range(1, 4):
            near = list(words)
            for p in rng.integers(0, 120, c - 1):
                near[p] = "changed"
            rows.append((10 * k + c, " ".join(near), "en", "s"))
            copies.add(10 * k + c)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs_of(spark, rows)).collect()}
    assert {10 * k for k in range(60)} <= kept and len(kept & copies) <= 0.02 * len(copies)


def test_unusual_documents_stay(spark, weird):
    kept = sorted((r.doc_id for r in simhash.drop_near_duplicates(weird).collect()), key=lambda v: (v is None, v))
    assert kept == [1, 2, 3, 4, 5, 6, 7, 8, None]


@pytest.mark.parametrize("local", [2_000_000, 20, 0])
def test_components_of_a_chain(spark, local):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint").repartition(4)
    got = {r.node: r.root for r in components(edges, local).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


# --- 9 top-k


def test_top_k_awkward_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (None, [0.0, 1.0]), (5, None), (6, [float("nan"), 0.0]), (7, [1.0]), (8, [2.0, None]), (9, []), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("v", F.lit(2))
    got = sorted(((r.vec_id, r.rank, r.neighbor_id, r.distance) for r in mtree.top_k(df, 2).collect()), key=repr)
    assert len(got) == 10 and {g[0] for g in got} == {1, 2, 3, None}
    assert [g for g in got if g[0] == 1] == [(1, 1, 2, 0.0), (1, 2, 3, 1.0)]
    assert mtree.top_k(df.limit(0), 2).count() == 0


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=(40, 8)) * 0.01 + 3])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(i, k + 1): int(j) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:5])}
    assert {(r.vec_id, r.rank): r.neighbor_id for r in mtree.top_k(df, 5, shard=50).collect()} == want


def test_top_k_saves_distances_on_clusters(spark):
    rng = np.random.default_rng(90)
    x = (rng.normal(size=(40, 16))[:, None, :] * 20 + rng.normal(size=(40, 100, 16)) * 0.1).reshape(-1, 16) * 1_000  # norms of 80,000
    x[:30] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    computed = spark.sparkContext.accumulator(0)
    got = {(r.vec_id, r.rank): (r.neighbor_id, r.distance) for r in mtree.top_k(df, 5, shard=400, computed=computed).collect()}
    d = np.stack([np.sqrt(((x - r) ** 2).sum(1)) for r in x])
    np.fill_diagonal(d, np.inf)
    for i, order in enumerate(np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :5]):
        assert [got[i, k][0] for k in range(1, 6)] == order.tolist() and np.allclose([got[i, k][1] for k in range(1, 6)], d[i, order])
    assert computed.value < 0.2 * len(x) ** 2


def test_top_k_of_some_queries(spark):
    """Queries of several shards in a task; the neighbours found are read from a table, not from a plan of unknown size."""
    x = np.random.default_rng(91).normal(size=(900, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [0.0] * 6)], "vec_id bigint, embedding array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    out = mtree.top_k(df.filter("vec_id is not null"), 4, shard=40, every=50)
    want = {(i, k + 1): int(j) for i in range(0, len(x), 50) for k, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:4])}
    assert {(r.vec_id, r.rank): r.neighbor_id for r in out.collect()} == want
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.vec_id for r in mtree.top_k(df, 4, every=50).collect()} == set(range(0, len(x), 50))
    assert mtree.top_k(df.filter("vec_id % 50 <> 0"), 4, every=50).count() == 0
    assert mtree._groups([3, 0, 5, 1], 4) == [[(0, 0, 3), (2, 0, 1)], [(2, 1, 5)], [(3, 0, 1)]]


# --- 10 packing


def test_hilbert_curve():
    for axes, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        key = packing.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("length", [7, 256, packing.LENGTH])
def test_packs_against_plain_python(spark, weird, length):
    """Keys one document at a time, an ordinary sort, and packs filled token by token."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(weird.withColumn("doc_id", F.col("doc_id") + 10**6))
    held = [(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect() if (r.text or "").split()]
    at = np.concatenate([packing.project(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for _, t, _ in held])
    mean = [sum(c) / len(c) for c in at.T]
    scale = [(sum((v - m) ** 2 for v in c) / len(c)) ** 0.5 for c, m in zip(at.T, mean)]
    cells = [[min(int(min(max((v - m) / s / (2 * packing.SPREAD) + 0.5, 0), 1) * 2**packing.BITS), 2**packing.BITS - 1) for v, m, s in zip(x, mean, scale)] for x in at]
    got = packing.pack(docs, length).collect()
    key = {r.doc_id: r.curve_key for r in got}
    same = [key[i] == int(packing.hilbert(np.array([c]))[0]) for (i, _, _), c in zip(held, cells)]
    assert sum(same) >= 0.99 * len(held)  # sums in another order may tip a document over a cell's border
    place, want = 0, []
    for i, text, _ in sorted(held, key=lambda r: (key[r[0]], r[0] is None, r[0] or 0, r[2])):
        n, done = len(text.split()) + 1, 0
        while done < n:
            take = min(n - done, length - place % length)
            want.append((place // length, place % length, i, done, take))
            place, done = place + take, done + take
    got.sort(key=lambda r: (r.pack_id, r.pack_start))
    assert [tuple(r)[:5] for r in got] == want
    whole, size = {}, {i: len(t.split()) + 1 for i, t, _ in held}
    for r in got:
        whole[r.doc_id] = whole.get(r.doc_id, "") + r.text
        assert len(r.text.split()) == r.n_tokens - (r.doc_start + r.n_tokens == size[r.doc_id])
    assert whole == {i: t * sum(i == j for j, _, _ in held) for i, t, _ in held}
