"""Operators over documents against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from panelflow.llm import bpe, common, lines, mixing, private_data, quality, simhash, token_files
from panelflow.llm.common import components, table
from panelflow.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def closure(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == closure(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_one_task_and_by_all(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(-200, 200, (230, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 3), (4, None), (9, 9)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    real = [(a, b) for a, b in edges if None not in (a, b) and a != b]
    want = closure({x for e in real for x in e}, real)
    for local in (0, 20, 1 << 20):
        assert {r.node: r.component for r in components(df, local).collect()} == want


def test_small_edges_end_in_one_round(spark, monkeypatch):
    made = []
    stored = common.Stored.__init__
    monkeypatch.setattr(common.Stored, "__init__", lambda self, df, name: made.append(name) or stored(self, df, name))
    components(spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")).count()
    assert len(made) == 2


def test_batches_of_whole_texts_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    wide = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "b"])

    spark.conf.unset(key)
    for use in (bpe.digests, bpe.encode, simhash.fingerprints, lines.sign, lambda d: quality.score(d, quality.Model(np.zeros(quality.BUCKETS, np.float32), 0.0))):
        spark.conf.unset(key)
        use(wide)
        got = wide.mapInArrow(sizes, "n long, b long").collect()
        assert sum(r.n for r in got) == 3000 and max(r.b for r in got) < 2 * common.BATCH_BYTES
    spark.conf.set(key, "1m")
    bpe.digests(wide)
    assert spark.conf.get(key) == "1m"  # the user's own bound stays
    spark.conf.unset(key)


# --- operator 4


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(spark, sf, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_vp_tree"](spark, sf).collect()}
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fps)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert got == {i: (f"{fps[i]:016x}", c) for i, c in closure(ids, near).items()}


def test_vp_tree_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near = base[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, near[:50] ^ np.uint64(7)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.component for r in components(simhash.links(df, 3, shard_rows=128)).collect()}
    far = np.bitwise_count(fps[:, None] ^ fps[None, :])
    s = fps.view(np.int64).tolist()
    pairs = [(s[a], s[b]) for a, b in zip(*np.nonzero((far <= 3) & (far > 0)), strict=True)]
    assert got == closure({x for p in pairs for x in p}, pairs)


def test_simhash_odd(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 11
    by = collections.defaultdict(set)
    for r in got:
        by[r.component_id].add(r.doc_id)
    assert by[1] == {1, 2, 8} and by[3] >= {3, 4, None}
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 8)} == {"0" * 16}
    stay = simhash.representatives(odd)
    assert stay.columns == odd.columns and {r.doc_id for r in stay.collect()} >= {1, 3, 6, 7, 9} and not {r.doc_id for r in stay.collect()} & {2, 4, 8}
    assert simhash.near_duplicates(nothing).count() == 0


def test_representatives_of_repeated_ids(spark):
    a, b = "some first text about ships and rivers", "quite another text on trains and hills"
    rows = [(3, b), (5, a), (5, b), (7, a), (7, a), (8, a), (None, "alone " * 5), (None, "alone " * 5), (None, "other words here now")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, _rows int, label string")
    got = simhash.representatives(df)
    assert got.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter([(3, b), (5, a), (None, "alone " * 5), (None, "other words here now")])


# --- operator 8


def test_bpe_matches_library(spark, sf, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    for r in QUERIES["op8_bpe_backtracking"](spark, sf).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_round_trip_and_odd(odd, nothing):
    back = bpe.decode(bpe.encode(odd))
    assert collections.Counter((r.doc_id, r.text or "") for r in odd.collect()) == collections.Counter((r.doc_id, r.text) for r in back.collect())
    assert bpe.encode(nothing).count() == 0
    c = bpe.codec(bpe.default_path())
    assert c.decode(np.array([], np.int64)) == "" and c.decode(c.encode("<|endoftext|> x")) == "<|endoftext|> x"


# --- operator 3


def test_token_files(spark, sf, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_files.default_path())
    start = 0
    for r in QUERIES["op3_token_files"](spark, sf).orderBy("doc_id").collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_file_layout(spark, odd, nothing, tmp_path):
    folder = str(tmp_path / "orc")
    token_files.write(odd, folder)
    one = token_files.read(spark, folder, 3).collect()
    assert [r.doc_id for r in one] == [3, 3] and one[0].ids[-1] == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in token_files.read(spark, folder, 3)._jdf.queryExecution().toString()
    rows = token_files.index(token_files.read(spark, folder)).collect()
    assert len(rows) == 11 and sorted(r.start for r in rows)[0] == 0
    assert token_files.round_trip(nothing).count() == 0


def test_starts_of_repeated_ids_follow_the_files(spark, tmp_path):
    rows = [(1, "one two three four"), (1, "five"), (1, "six seven"), (2, "eight"), (None, "nine ten"), (1, None)]
    folder = str(tmp_path / "orc")
    token_files.write(spark.createDataFrame(rows * 3, "doc_id long, text string"), folder)
    files = token_files.read(spark, folder)
    stream, at = [], {}
    for r in files.orderBy("shard", "row").collect():
        at[len(stream)] = (r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        stream += r.ids
    assert {r.start: (r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.index(files).collect()} == at and len(at) == 18
    order = [-1 if d is None else d for d, _, _ in at.values()]
    assert order == sorted(order)


def test_orc_stripes_index_and_filter(spark, tmp_path):
    """The files hold run-length streams, a row index and a Bloom filter on doc_id, in stripes."""
    folder = tmp_path / "orc"
    docs = spark.range(0, 5000, 1, 1).selectExpr("id * 7 as doc_id", "concat('word ', id) as text")
    token_files.write(docs, str(folder))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kinds, total = set(), 0
    for file in folder.glob("*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_files.ROW_INDEX_STRIDE
        total += reader.getNumberOfRows()
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds |= {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
            assert footer.getColumns(5).getKind().toString() == "DIRECT_V2"  # the ids: run-length encoding, version 2
        rows.close()
        reader.close()
    assert total == 5000 and {(1, "ROW_INDEX"), (1, "BLOOM_FILTER_UTF8"), (5, "ROW_INDEX")} <= kinds and (5, "BLOOM_FILTER_UTF8") not in kinds
    assert [r.doc_id for r in token_files.read(spark, str(folder), 700).collect()] == [700] and not token_files.read(spark, str(folder), 701).collect()


def test_long_chunks_are_not_remembered():
    e = token_files.Encoder(token_files.default_path())
    long = "x" * (token_files.REMEMBERED_CHARS + 1)
    for _ in range(2):
        ids, ends = e.encode(pa.array([f"word {long} word", None, long]))
        assert ids.tolist() == [i for t in (f"word {long} word", long) for i in e.tokenizer.encode(t, add_special_tokens=False).ids] and ends[1] == ends[2]
    assert "word" in e.known and long not in e.known


def test_token_file_batches_are_bounded(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    token_files.write(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), str(tmp_path / "t"))
    assert spark.conf.get(key) == str(common.BATCH_BYTES)
    spark.conf.unset(key)


def test_chunked_encoding_is_exact():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_files.default_path())
    e = token_files.Encoder(token_files.default_path())
    for s in ["Don't, stop..  now.,", "a.b.c.", "<|endoftext|>, x.", "É. é. Ünder,", "U.S.A., 3.5. A.,'s", "\x85x　y", "It's. WE'LL,", "a\x1cb\x0b.c\x1f", "ÀÖß. Ÿ, ø,. ªº µ."]:
        assert e.encode(pa.array([s]))[0].tolist() == lib.encode(s, add_special_tokens=False).ids


# --- operator 5


def slow_spans(text):
    def luhn(d):
        s = [int(c) for c in reversed(d)]
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(s)) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def agree(rows, texts):
    for r in rows:
        spans = slow_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in private_data.KINDS]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans.startswith(listed)


def test_private_data(spark, sf, texts):
    agree(QUERIES["op5_private_data"](spark, sf).collect(), texts)


def test_private_data_hard_cases(spark):
    hard = ["a@b.co_x@y.zz x@y@z.com é@a.b ü.x@d-e.f-g.h", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1..2.3.4", "4111-1111 1111 1111 41111111111111112 4111  1111", "+1 (389) 555-5010 ++49.30.1234567 +1 ((((( +12 3", "9" * 40000, "a" * 40000 + "@", "+1" + " " * 30000, "🙂 a@b.c 🙂 +4930123456", "1" * 16 + "a" + "0" * 16]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    agree(private_data.digests(df).collect(), dict(enumerate(hard)))


def test_disclosing_terms(spark):
    rows = [(i, f"write to ada@site.org about zanzibar trip {i} via common road") for i in range(6)] + [(10 + i, f"common road words number {i} are here") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.term for r in private_data.disclosing_terms(df).collect()} == {"write", "about", "zanzibar", "trip"}
    found = private_data.find(df)
    clean = {r.doc_id: r.text for r in private_data.sanitised(found).collect()}
    assert clean[0] == "[REMOVED] to [EMAIL] [REMOVED] [REMOVED] [REMOVED] 0 via common road" and clean[12] == rows[8][1]
    # a document without the entity is left alone
    more = df.unionByName(spark.createDataFrame([(99, "zanzibar stands alone here")], "doc_id long, text string"))
    assert "zanzibar" in {r.term for r in private_data.disclosing_terms(more).collect()}
    assert [r.spans for r in private_data.digests(more).collect() if r.doc_id == 99] == [""]
    # copies of one line prove nothing
    same = spark.createDataFrame([(i, rows[0][1]) for i in range(9)] + rows[6:], "doc_id long, text string")
    assert private_data.disclosing_terms(same).count() == 0


def test_terms_are_generalised_or_removed(spark):
    """Of two words that disclose less than all, the one with a stem of others gets that stem, the other goes."""
    rows = [f"mail ada{i % 1}@site.org on zanzibar and quixote {i}" for i in range(10)] + [f"zanzibar with quixote {i}" for i in range(2)] + [f"zanzilla {i}" for i in range(30)] + [f"other words {i}" for i in range(958)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.term: r for r in private_data.disclosing_terms(df).collect()}
    assert private_data.GENERALISE <= got["zanzibar"].disclosed < private_data.REMOVE and got["zanzibar"].general == "zanzi" and got["quixote"].general is None
    clean = {r.doc_id: r.text for r in private_data.sanitised(private_data.find(df)).collect()}
    assert clean[3] == "[REMOVED] [EMAIL] on zanzi* and [REMOVED] 3" and clean[10] == rows[10] and clean[12] == rows[12]
    strict = private_data.sanitised(private_data.find(df, remove=0.9)).where("doc_id = 3").first().text
    assert strict == "[REMOVED] [EMAIL] on [REMOVED] and [REMOVED] 3"


def test_risk_is_of_the_text_not_of_the_id(spark):
    rows = [(1, f"write to ada@site.org about zanzibar trip {i}") for i in range(6)] + [(1, "zanzibar stands alone here")] + [(9, f"common road {i}") for i in range(60)]
    got = private_data.digests(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").collect()
    assert sorted(r.spans.count("term:") for r in got) == [0] + [4] * 6


def test_spaced_phones_and_far_words_count(spark):
    rows = [(i, f"call +1   2   3   4   5   6   7   8 in zanzibar {i}" + " far" * 100 + " quixote") for i in range(4)] + [(9 + i, f"common road {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.term for r in private_data.disclosing_terms(df).collect()} == {"call", "zanzibar"}


def test_private_data_odd(odd, nothing):
    got = private_data.digests(odd).collect()
    assert len(got) == 11 and [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got if r.doc_id == 9] == [(1, 1, 1, 1)]
    assert private_data.digests(nothing).count() == 0


# --- operator 2


def test_mixing_matches_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = collections.Counter(c.execute("select doc_id, domain, lang, source, tokens, copies from (" + mixing.oracle() + ")").fetchall())
    got = collections.Counter((r.doc_id, r.domain, r.lang, r.source, r.tokens, r.copies) for r in QUERIES["op2_source_mixing"](spark, sf).collect())
    assert got == want and got


def slow_fill(cap, w, budget):
    """Water-filling by rounds of integers."""
    alloc, open_ = dict.fromkeys(cap, 0), {k for k in cap if cap[k]}
    full = set()
    while True:
        rest = budget - sum(cap[k] for k in full)
        weight = sum(w[k] for k in cap if k not in full)
        new = {k for k in cap if k not in full and cap[k] * weight <= w[k] * rest}
        if not new:
            break
        full |= new
    alloc = {k: cap[k] if k in full else w[k] * rest // weight for k in cap}
    spare = rest - sum(alloc[k] for k in cap if k not in full)
    for k in sorted(k for k in cap if k not in full)[:spare]:
        alloc[k] += 1
    return alloc


def test_fill_moves_shortages_to_siblings(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        cap = {f"c{i}": int(rng.integers(0, 100)) for i in range(9)}
        w = {k: int(rng.integers(1, 6)) for k in cap}
        budget = min(sum(cap.values()), int(rng.integers(0, 500)))
        df = spark.createDataFrame([("p", k, cap[k], w[k], budget) for k in cap], "parent string, child string, cap long, w long, budget long")
        got = {r.child: r.alloc for r in mixing.fill(df, ["parent"], "child").collect()}
        assert got == slow_fill(cap, w, budget) and sum(got.values()) == budget


def test_mixing_odd(odd, nothing):
    rows = mixing.select(odd, budget=10**9).collect()
    assert len(rows) == 11 and {r.copies for r in rows} == {mixing.MAX_EPOCHS}
    few = mixing.select(odd, budget=40).collect()
    assert sum(r.tokens * r.copies for r in few) <= 40
    out = mixing.mixed(odd, budget=10**9)
    assert out.columns == odd.columns and out.count() == 22
    assert mixing.select(nothing).count() == 0


def test_mixed_rows_of_one_id_keep_to_the_budget(spark):
    rows = [(1, "a", "en", "src0"), (1, "a b c d", "en", "src0"), (1, "a b", "en", "src0"), (None, "a b c", "en", "src0"), (2, "a b c d e", "en", "src0"), (1, "a", "en", "src0")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, _copies int, _row string")
    for budget in (1, 3, 5, 9, 16, 20, 40):
        chosen = collections.Counter()
        for r in mixing.select(df, budget=budget).collect():
            chosen[r.doc_id, r.tokens] += r.copies
        out = mixing.mixed(df, budget=budget)
        assert out.columns == df.columns
        assert collections.Counter((r.doc_id, len(r.text.split(" "))) for r in out.collect()) == chosen
        assert sum(n * t for (_, t), n in chosen.items()) <= budget


# --- operator 1


def test_lines_against_all_pairs(spark, sf, texts):
    got = QUERIES["op1_fuzzy_lines"](spark, sf).collect()
    first, order = {}, sorted(texts)
    for i in order:
        for no, line in enumerate(texts[i].split("\n")):
            if line.strip(lines.BLANK):
                first.setdefault(line, (i, no))
    sets = {line: lines.shingles(line) for line in first}
    by_size = sorted(first, key=lambda x: len(sets[x]))
    pairs = []
    for k, a in enumerate(by_size):
        for b in by_size[k + 1 :]:
            if len(sets[a]) < 0.8 * len(sets[b]):
                break
            if lines.similar(sets[a], sets[b]):
                pairs.append((first[a], first[b]))
    want = closure(list(first.values()), pairs)
    wrong = 0
    for r in got:
        line = texts[r.doc_id].split("\n")[r.line_no]
        rep = want[first[line]] if line.strip(lines.BLANK) else (r.doc_id, r.line_no)
        wrong += (r.rep_doc_id, r.rep_line_no) != rep
        assert r.kept == ((r.doc_id, r.line_no) == (r.rep_doc_id, r.rep_line_no))
    assert len(got) == sum(len(t.split("\n")) for t in texts.values()) and wrong <= 0.01 * len(got)


def test_shingles_are_exact():
    rng = np.random.default_rng(6)
    plain = lambda x: {x[i : i + 8] for i in range(max(1, len(x) - 7))}
    texts = ["", "abc", "abcdefg", "abcdefgh", "\x00" * 7, "\x00" * 8, "\x00" * 9, "aaaaaaaaaaaaaaaa", "naïve café crème, déjà vu", "日本語のテキスト and some Latin text", "Latin text and 日", "ÿ" * 12, "Āÿÿÿÿÿÿÿÿÿ", "\U0001f600 smile at the end"]
    texts += ["".join(chr(c) for c in rng.choice([97, 98, 255, 256, 353, 0x1F600], 40)) for _ in range(60)]
    for a in texts:
        assert len(lines.shingles(a)) == len(plain(a))
        for b in texts:
            assert len(lines.shingles(a) & lines.shingles(b)) == len(plain(a) & plain(b))
    assert all(isinstance(s, int) for s in lines.shingles("a line of plain text"))  # texts cost twice the time


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK", 8)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(40)]
    rows = [words[:]]
    for i in range(1, 120):  # a chain: each differs from the one before in one word, ends are far apart
        row = rows[-1][:]
        row[i % 40] = f"w{i:05d}"
        rows.append(row)
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    got = lines.classes(df).collect()
    assert {(r.rep_doc_id, r.rep_line_no) for r in got} == {(0, 0)} and sum(r.kept for r in got) == 1


def test_lines_odd(odd, nothing):
    got = lines.classes(odd).collect()
    kept = {(r.doc_id, r.line_no) for r in got if r.kept}
    assert (None, 0) in kept and (1, 0) in kept and (8, 2) in kept and not {(3, 0), (4, 0), (9, 1), (9, 2)} & kept
    out = lines.deduplicated(odd)
    assert out.columns == odd.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert set(text) == {None, 1, 2, 5, 6, 7, 8, 9} and text[9].startswith("mail") and "\n" not in text[9] and text[8] == "\n\n \n"
    assert lines.classes(nothing).count() == 0 and lines.deduplicated(nothing).count() == 0


def test_lines_of_repeated_ids(spark):
    a, b, c = LINE_A, LINE_B, "a third line that nothing else is like at all, and stays"
    df = spark.createDataFrame([(i, t, 4, "x") for i, t in [(0, a), (1, a), (1, b), (2, b + " x"), (1, c + "\n" + a)]], "doc_id long, text string, _id int, _mark string")
    reps = collections.Counter((r.doc_id, r.rep_doc_id, r.rep_line_no, r.kept) for r in lines.classes(df).collect())
    assert reps == collections.Counter([(0, 0, 0, True), (1, 0, 0, False), (1, 1, 0, True), (2, 1, 0, False), (1, 1, 0, True), (1, 0, 0, False)])
    out = lines.deduplicated(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(0, a), (1, b), (1, c)])


def test_hot_lines_are_named_like_others(spark, monkeypatch):
    rows = [(i, "\n".join([LINE_A, f"own line {i} of this row {i * 7919}", ""])) for i in range(60)] + [(100, LINE_A + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hot = sorted(lines.classes(df).collect())
    monkeypatch.setattr(lines, "HOT_SHARE", 0)
    assert hot == sorted(lines.classes(df).collect())
    assert {(r.rep_doc_id, r.rep_line_no) for r in hot if r.line_no == 0} == {(0, 0)} and sum(r.kept for r in hot if r.line_no == 0) == 1


LINE_A = "the quick brown fox jumps over the lazy dog near the old stone bridge"
LINE_B = "seven wizards boil tea while a small ship leaves the northern harbour at dawn"


# --- operator 10


def test_quality_on_held_out_rows(spark, sf):
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    got = QUERIES["op10_quality_subwords"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_scores_are_softmax_of_averaged_vectors():
    """The fast sum of one number a feature equals averaging vectors and a softmax, feature by feature."""
    good = ["the river runs to the sea, and ships follow it", "A house of stone stands on the hill.", "she wrote letters every day in May"]
    bad = ["BUY NOW!!! buy now BUY 100 % free", "click click click here here 99 $$$", "xx yy xx yy zz 0 0 0"]
    texts, y = good + bad, [1, 1, 1, 0, 0, 0]
    table, out, bias = quality.vectors([quality.counted(t) for t in texts], np.array(y))
    model = quality.fit(texts, y)
    for text in [*texts, "", "   ", "Ünder wörds 7x", "same same same", "a"]:
        words = text.split()
        features = [f for w in words for f in quality.word_features(w)]
        features += [quality._bucket(f"p{quality.shape(a)} {quality.shape(b)}") for a, b in zip(words, words[1:])]
        features += [quality._bucket("p=")] * (quality.PAIR_WEIGHT * sum(a == b for a, b in zip(words, words[1:])))
        mean = sum((table[f].astype(np.float64) for f in features), np.zeros(quality.DIM)) / (quality.NEUTRAL + len(features))
        z = out @ mean + bias
        p = np.exp(z - z.max())
        assert abs(model.score(text) - p[1] / p.sum()) < 1e-4, text
    assert all(model.score(t) > 0.5 for t in good) and all(model.score(t) < 0.5 for t in bad)


def test_quality_learns_from_long_rows_and_repeated_ids(spark):
    docs = spark.createDataFrame([(i, ("good words of a story " if i % 2 else "BAD BAD !!! 0 ") * (4000 if i < 6 else 3)) for i in range(40)] + [(1, "good words of a story again")] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample_rows=20)
    assert model.score("good words of a story") > model.score("BAD BAD !!! 0")


def test_quality_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(3, 1), (4, 1), (6, 0), (7, 0), (None, 1), (5, None), (9, 5)], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == 11 and len({r.score for r in got if r.doc_id in (1, 2, 8)}) == 1
    assert quality.classify(nothing, labels.limit(0)).count() == 0
    assert quality.keep(odd, quality.fit([], [])).columns == odd.columns


def test_line_places_of_any_id(spark):
    ids = [None, -(1 << 63), -(1 << 40), -(1 << 31) - 1, -(1 << 31), -1, 0, (1 << 31) - 1, 1 << 31, (1 << 63) - 1]
    rows = [(i, n, n) for i in ids for n in (0, 7, (1 << 31) - 1)]
    df = spark.createDataFrame(rows, "doc_id long, line_no int, same int").withColumn("place", lines._place())
    back = df.select("doc_id", "line_no", "place", *[c.alias(n) for c, n in zip(lines._from_place("place"), ("d", "l"), strict=True)]).collect()
    assert all((r.doc_id, r.line_no) == (r.d, r.l) for r in back)
    assert [(r.doc_id, r.line_no) for r in sorted(back, key=lambda r: r.place)] == [r[:2] for r in rows]


def test_classifier_memory_of_a_worker(spark, monkeypatch):
    """Words met once are not remembered, those remembered are bounded, and no list of rows goes through Python workers."""
    monkeypatch.setattr(quality, "REMEMBERED", 300)
    model = quality.Model(np.random.default_rng(3).normal(size=quality.BUCKETS).astype(np.float32), 0.1)
    once, again = " ".join(f"single{i}" for i in range(2000)), "again " * 5
    fresh = lambda t: quality.Model(model.weights, 0.1).score(t)
    assert model.score(once) == fresh(once) and model.score(again) == fresh(again)
    assert "again" in model.known and len(model.known) < 20  # a few marks may meet
    for _ in range(2):
        assert model.score(once) == fresh(once)
        assert len(model.known) <= 300
    made = []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, f=type(spark).createDataFrame, **b: made.append(data) or f(self, data, *a, **b))
    docs = spark.range(20).selectExpr("id as doc_id", "if(id % 2 = 0, 'good words here', 'BAD 0 !!!') as text")
    got = quality.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as quality"))
    assert got.score("good words") > got.score("BAD 0") and not any(isinstance(x, list) for x in made)
