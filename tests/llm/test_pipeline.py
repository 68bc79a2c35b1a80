"""Every stage of the pipeline against a plain Python version, on the small tables and on odd rows."""

import collections
import hashlib

import pytest

from panelflow.llm import lines, mixing, quality
from panelflow.llm.common import table

from test_documents import closure, slow_fill, slow_fingerprint


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def slow_lines(docs):
    """Texts without lines that are like an earlier one, by comparing all pairs of distinct lines."""
    first = {}
    for i, (doc_id, text, *_rest) in enumerate(docs):
        for no, line in enumerate((text or "").split("\n")):
            if line.strip(lines.BLANK):
                first.setdefault(line, []).append((doc_id, no, i))
    place = {line: min(at)[:2] for line, at in first.items()}
    sets = {line: lines.shingles(line) for line in first}
    order = sorted(first, key=lambda x: len(sets[x]))
    pairs = []
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if len(sets[a]) < lines.THRESHOLD * len(sets[b]):
                break
            if lines.similar(sets[a], sets[b]):
                pairs.append((place[a], place[b]))
    head = closure(set(place.values()), pairs)
    out = []
    for doc_id, text, lang, source, n_chars in docs:
        kept, gone = [], False
        for no, line in enumerate((text or "").split("\n")):
            if not line.strip(lines.BLANK) or head[place[line]] == (doc_id, no):
                kept.append(line)
            else:
                gone = True
        whole = "\n".join(kept)
        if not gone:
            out.append((doc_id, text, lang, source, n_chars))
        elif whole.strip(lines.BLANK + "\n"):
            out.append((doc_id, whole, lang, source, len(whole)))
    return out


def slow_copies(docs):
    fps = {d[0]: slow_fingerprint(d[1] or "") for d in docs}
    ids = sorted(fps)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fps[a] ^ fps[b]).bit_count() <= 3]
    heads = set(closure(ids, near).values())
    return [d for d in docs if d[0] in heads]


def slow_mix(docs):
    """Budgets level by level, then whole epochs and the prefix of one more, leaf by leaf."""
    def node(d):
        digits = d[3][len(d[3].rstrip("0123456789")) :]
        return (mixing.DOMAINS[int(digits) % 4] if digits else "?", d[2], d[3])

    size = {d[0]: len(d[1].split(" ")) if d[1] else 0 for d in docs}
    leaves = collections.defaultdict(list)
    for d in docs:
        leaves[node(d)].append(d)
    caps = {k: mixing.MAX_EPOCHS * sum(size[d[0]] for d in v) for k, v in leaves.items()}
    given = {(): sum(size.values()) * mixing.SHARE[0] // mixing.SHARE[1]}
    for level, name in enumerate(mixing.LEVELS):
        shares = {}
        for parent, budget in given.items():
            below = collections.Counter()
            for k, c in caps.items():
                if k[:level] == parent:
                    below[k[level]] += c
            weights = {c: mixing.WEIGHTS.get(name, {}).get(c, 1) for c in below}
            for child, got in slow_fill(dict(below), weights, budget).items():
                shares[(*parent, child)] = got
        given = shares
    out = []
    for k, members in leaves.items():
        tokens = sum(size[d[0]] for d in members)
        passes = min(given[k] // tokens, mixing.MAX_EPOCHS) if tokens else mixing.MAX_EPOCHS
        rest, used = given[k] - passes * tokens, 0
        for d in sorted(members, key=lambda d: (hashlib.md5(f"{mixing.SEED}:{passes}:{d[0]}".encode()).hexdigest(), d[0])):
            used += size[d[0]]
            out += [d] * (passes + (passes < mixing.MAX_EPOCHS and used <= rest))
    return out


def test_stages_against_plain_python(spark, sf):
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    from panelflow.llm import bpe

    docs = table(spark, sf, "documents")
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing sources", "bpe encoding and decoding"]
    stage = dict(cp.STAGES)
    names = docs.columns

    labels = table(spark, sf, "labels", "doc_id", "quality")
    model = quality.train(docs, labels)
    good = stage["quality classifier"](spark, docs, sf).persist()
    assert rows_of(good) == collections.Counter(tuple(d) for d in docs.collect() if model.score(d.text or "") >= quality.THRESHOLD)

    plain = stage["line dedup"](spark, good, sf).persist()
    want = collections.Counter(slow_lines([tuple(d[n] for n in ("doc_id", "text", "lang", "source", "n_chars")) for d in good.collect()]))
    got = rows_of(plain.select("doc_id", "text", "lang", "source", "n_chars"))
    assert sum(((got - want) + (want - got)).values()) <= 0.02 * sum(want.values())  # banding may miss pairs at the threshold

    single = stage["simhash near-dedup"](spark, plain, sf).persist()
    of = [tuple(d[n] for n in ("doc_id", "text", "lang", "source", "n_chars")) for d in plain.collect()]
    assert rows_of(single.select("doc_id", "text", "lang", "source", "n_chars")) == collections.Counter(slow_copies(of))

    mixed = stage["mixing sources"](spark, single, sf).persist()
    of = [tuple(d[n] for n in ("doc_id", "text", "lang", "source", "n_chars")) for d in single.collect()]
    assert rows_of(mixed.select("doc_id", "text", "lang", "source", "n_chars")) == collections.Counter(slow_mix(of))
    assert good.columns == plain.columns == single.columns == mixed.columns == names

    lib = Tokenizer.from_file(bpe.default_path())
    coded = stage["bpe encoding and decoding"](spark, mixed, sf).collect()
    want = collections.Counter()
    for d in mixed.collect():
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        want[d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded) == want


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, sf, odd, empty):
    import corpus_pipeline as cp

    docs = odd.limit(0) if empty else odd
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == odd.columns, name
        assert empty == (after.count() == 0) or name == "quality classifier", name
        # every stage is given all odd rows, as a classifier may reject them
    assert cp.STAGES[-1][1](spark, docs, sf).count() == (0 if empty else 11)
