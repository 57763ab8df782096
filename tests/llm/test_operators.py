"""Each operator against a plain version on small tables, and on odd rows."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, golomb, html_text, language_id, mixing, near_dedup, quality, suffix_dedup, toxicity, url_filter
from tessera.llm.common import held_out, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def quality_by_hand(t):
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("bits", [24, 60])  # with 60 bits for positions all hashes clash
def test_quality(spark, odd_docs, monkeypatch, bits):
    monkeypatch.setattr(quality, "POSITION_BITS", bits)
    for docs in (odd_docs, table(spark, SF, "documents")):
        got = quality.judge(docs).select("row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        for r in got:
            n = quality_by_hand(r["text"] or "")
            assert tuple(r)[1:6] == n
            assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])


def test_quality_keeps_columns_and_clean_rows(spark, odd_docs, no_docs):
    kept = quality.keep(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 7, 8, None}
    assert quality.keep(no_docs).count() == 0
    docs = table(spark, SF, "documents").join(table(spark, SF, "labels").where("quality = 1"), "doc_id")
    judged = quality.judge(docs)
    assert judged.where("not base_failed and not kept").count() == 0


def test_quality_keeps_long_clean_texts(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["the"] + [f"word{k}" for k in range(3000)]
    book = " ".join(vocabulary[k] for k in np.where(rng.random(60_000) < 0.1, 0, rng.integers(0, 3001, 60_000)))
    few = " ".join(["the", "and", *(f"w{k}" for k in range(10))][k] for k in rng.integers(0, 12, 2000))
    rows = [(1, book), (2, few), (3, " ".join(["the cat"] * 400)), (4, ""), (5, "x " * 501)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "kept", "n_words", "n_distinct_words", "n_repeat_words").collect()}
    assert len(set(book.split())) < 0.1 * got[1]["n_words"] and got[1]["kept"]
    for k, t in rows:
        w = t.split()
        assert got[k]["n_distinct_words"] == sum(len(set(w[i : i + 500])) for i in range(0, len(w), 500))
    assert not any(got[k]["kept"] for k in (2, 3, 4, 5))


def test_quality_finds_repeats_beyond_the_position_bits(spark, monkeypatch):
    monkeypatch.setattr(quality, "POSITION_BITS", 4)
    rows = [(k, " ".join([f"t{k}w{i}" for i in range(40)] + [f"t{k}w{i}" for i in range(20, 25)])) for k in range(20)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).select("n_repeat_words").collect()
    assert [r[0] for r in got] == [10] * 20


def test_golomb_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 100, 5000):
        v = np.unique(rng.integers(0, 1 << golomb.BITS, n))
        assert (golomb.decode(golomb.encode(v)) == v).all()
    dense = np.arange(1000)
    assert (golomb.decode(golomb.encode(dense)) == dense).all() and len(golomb.encode(dense)) < 300


def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("owner", [500_000, 3])
def test_exact_dedup(spark, odd_docs, no_docs, monkeypatch, owner):
    monkeypatch.setattr(exact_dedup, "PER_OWNER", owner)
    for docs in (odd_docs, table(spark, SF, "documents")):
        expected, rows = exact_by_hand(texts(docs)), {}
        keyed, d = exact_dedup.decide(docs)
        for r in keyed.join(d, "rid").select("row.text", "keep_id", "group_size", d["kept"], "sha").collect():
            t = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
            assert (r["keep_id"], r["group_size"]) == expected[t] and r["sha"] == hashlib.sha256(t.encode()).hexdigest()
            rows[t] = rows.get(t, 0) + r["kept"]
        assert set(rows.values()) == {1}
        assert exact_dedup.deduplicate(docs).count() == len(expected)
    assert exact_dedup.deduplicate(no_docs).columns == no_docs.columns and exact_dedup.deduplicate(no_docs).count() == 0


def bag(t):
    w = WORD.findall(t)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes_by_hand(rows):
    bags = [bag(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            if a and b and (n := sum((a & b).values())) >= 0.8 * (sum(a.values()) + sum(b.values()) - n) - 1e-9:
                label = [label[j] if x == label[i] else x for x in label]
    out = {}
    for (i, _), x in zip(rows, label, strict=True):
        out.setdefault(x, []).append(i)
    return sorted(sorted(map(str, ids)) for ids in out.values())


@pytest.mark.parametrize("piece", [2048, 2])
def test_near_dedup(spark, odd_docs, no_docs, monkeypatch, piece):
    monkeypatch.setattr(near_dedup, "PIECE_DOCS", piece)
    base = [f"w{i}" for i in range(60)]
    drift = [(100 + k, " ".join(w if i % 20 or i // 20 >= k else f"x{k}{i}" for i, w in enumerate(base))) for k in range(4)]
    more = spark.createDataFrame(drift, "doc_id long, text string")
    for docs in (odd_docs.select("doc_id", "text").union(more), table(spark, SF, "documents")):
        _, c = near_dedup.classes(docs)
        got = {}
        for r in c.collect():
            got.setdefault((r["class_id"], r["class_size"] if r["class_id"] is None else 0, r["rid"] if r["class_id"] is None else 0), []).append((r["id"], r["kept"]))
        assert all(sum(k for _, k in g) == 1 for g in got.values())
        if docs.columns == ["doc_id", "text"] and docs.count() < 50:
            assert sorted(sorted(str(i) for i, _ in g) for g in got.values()) == classes_by_hand(texts(docs))
    assert near_dedup.deduplicate(no_docs).count() == 0
    assert near_dedup.deduplicate(odd_docs).columns == odd_docs.columns


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 9, 300)
    b = np.where(rng.random(300) < 0.8, a, rng.integers(0, 9, 300))
    key = near_dedup._mix(np.arange(1, 301).astype(np.uint64))
    parts = [(key[w > 0], w[w > 0], np.full((w > 0).sum(), d)) for d, w in enumerate((a, b))]
    s = near_dedup.bag_minhash(*[np.concatenate(x) for x in zip(*parts, strict=True)], 2, 6000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def passages_by_hand(rows):
    inf, least, out = 1 << 62, {}, []
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - 49):
            least[b[p : p + 50]] = min(least.get(b[p : p + 50], inf), inf if i is None else i)
    for i, t in rows:
        b = t.encode()
        r = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < (inf if i is None else i):
                r[p : p + 50] = True
        kept = bytes(x for x, gone in zip(b, r, strict=False) if not gone)
        out.append((i, len(b), int(r.sum()), int(np.count_nonzero(np.diff(np.r_[0, r.astype(int)]) == 1)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [4_000_000, 30_000])
def test_suffix_dedup(spark, odd_docs, no_docs, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    for docs in (odd_docs, table(spark, SF, "documents")):
        got = sorted(map(tuple, suffix_dedup.cut(docs, keep_text=False).collect()), key=str)
        assert got == passages_by_hand(texts(docs))
    assert suffix_dedup.cut(no_docs).count() == 0


def test_suspects_between_many_senders_and_owners(spark, monkeypatch):
    """Fingerprints that occur again are found wherever their rows are, and no others."""
    for name, value in (("PER_SENDER", 1), ("PER_OWNER", 1), ("BLOCK_BITS", 0)):
        monkeypatch.setattr(exact_dedup, name, value)
    rng = np.random.default_rng(4)
    prints = [(k, int(v) << 38) for k, v in enumerate(rng.integers(0, 1000, 600))]
    prints += [(1000 + k, v) for k, v in enumerate(rng.integers(0, 1 << golomb.BITS, 300).tolist())]
    count = Counter(v for _, v in prints)
    got = exact_dedup.suspects(spark.createDataFrame(prints, "rid long, fp long"), len(prints)).collect()
    assert sorted(r["rid"] for r in got) == [k for k, v in prints if count[v] > 1]


def test_suffix_dedup_splits_frequent_anchors(spark, monkeypatch):
    """A short passage in many surroundings fills ranges of its own; its strings are grouped by their bytes."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 16)
    rng, seen, real = np.random.default_rng(5), [], suffix_dedup.splitters
    monkeypatch.setattr(suffix_dedup, "splitters", lambda *a: seen.append(real(*a)) or seen[-1])
    near = ["".join(map(chr, rng.integers(97, 123, 18))) for _ in range(40)]
    rows = [(k if k % 50 else None, f"{near[rng.integers(40)]}the same words stand here{near[rng.integers(40)]}") for k in range(400)]
    rows += [(None, rows[7][1])] * 30 + [(3, rows[9][1])] * 2
    got = sorted(map(tuple, suffix_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()), key=str)
    assert got == passages_by_hand(rows)
    (splits, frequent), = seen
    assert frequent and list(splits) == sorted(splits)


def test_suffix_dedup_holds_few_numbers_for_a_byte():
    """A chunk's anchors and cuts take no array of 8 bytes for every byte, its records are held a range at a time."""
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 123, 20_000).astype(np.uint8).tobytes() for _ in range(50)]
    rows = [(k, t) for k, t in enumerate(texts + texts)]
    group = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "t": pa.array([r[1] for r in rows], pa.binary()), "copies": pa.array([1] * len(rows), pa.int64())})
    size = sum(len(t) for _, t in rows)
    c = suffix_dedup.Chunk(group)
    some, data, splits = np.arange(len(c.at)), np.frombuffer(c.raw, np.uint8), np.array(sorted(c.grams(np.arange(0, len(c.at), 1000)).tolist()), f"S{suffix_dedup.GRAM}")
    best, out = np.arange(len(c.at)), []

    def records():
        for owner, part in c.ranges(some, splits):
            own, best[part] = c.records(part)
            out.append((owner, len(part), min(own)[0][: suffix_dedup.GRAM], max(own)[0][: suffix_dedup.GRAM]))

    for f in (lambda: suffix_dedup.anchors(data, c.start, c.end), records, lambda: c.removed(some, best, np.zeros(len(c.at), np.int64))):
        tracemalloc.start()
        f()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 * size
    assert sum(n for _, n, *_ in out) == len(some) and len(out) > 50
    assert all(x[3] < y[2] for x, y in zip(out, out[1:], strict=False))
    assert np.array_equal(best, c.records(some)[1])
    removed = c.removed(some, best, np.zeros(len(c.at), np.int64))
    assert not removed[: size // 2].any() and removed[size // 2 :].all()


@pytest.mark.parametrize("owners", [4, 100, 5000])
def test_suffix_dedup_deals_fingerprints_evenly(owners):
    """Anchors are least hashes; their owners must get about equal parts all the same."""
    data = np.random.default_rng(7).integers(97, 123, 4_000_000).astype(np.uint8)
    at, _, _, prints = suffix_dedup.anchors(data, np.array([0]), np.array([len(data)]))
    part = np.bincount(prints // -(-(1 << golomb.BITS) // owners), minlength=owners)
    assert len(at) > 200_000 and len(part) == owners
    mean = len(at) / owners
    assert np.abs(part - mean).max() < 6 * np.sqrt(mean)


def test_loser_tree_sorts_and_knows_prefixes():
    rng = np.random.default_rng(2)
    runs = [sorted((bytes(rng.integers(97, 100, 8).tolist()), b"", k, n) for n in range(int(rng.integers(0, 40)))) for k in range(5)]
    out = [(r, n) for _, n, r in suffix_dedup.merged([suffix_dedup.decoded(suffix_dedup.front_coded(r)) for r in runs])]
    strings = [r[0] for r, _ in out]
    assert strings == sorted(x[0] for r in runs for x in r)
    for a, b, (_, n) in zip(strings, strings[1:], out[1:], strict=False):
        assert n == next((k for k in range(8) if a[k] != b[k]), 8)


def test_bpe(spark, odd_docs, no_docs):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoding(path, P.PATTERN)
    for t in ("", "a b  c\n\n d", "it's " * 50, "x" * 3000 + " y", "  lead  trail  ", "ü ñ 漢字 \U0001f600 " * 30):
        for long in (1, 7, 50):
            assert bpe.encode(enc, t, long) == enc.encode_ordinary(t)
    for r in bpe.encode_documents(odd_docs, path, P.PATTERN).collect():
        assert hashlib.sha256(bytes(r["decoded"])).hexdigest() == r["decoded_sha256"] and len(r["ids"]) == r["n_tokens"]
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.encode_documents(odd_docs, path, P.PATTERN, digests_only=True).collect()}[4] == 0
    assert bpe.encode_documents(no_docs, path, P.PATTERN).count() == 0


def test_mixing_targets(spark):
    sizes = {"a": 100, "b": 100, "c": 1000, "d": 10, None: 0}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want, capped, weight = {}, set(), dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        want = {s: 3 * sizes[s] if s in capped else rest * w / sum(weight[x] for x in weight if x not in capped) for s, w in weight.items()}
        over = {s for s in want if want[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(want)


def test_mixing(spark, odd_docs, no_docs):
    docs = table(spark, SF, "documents")
    m = mixing.mix(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "draws")
    rows, again = m.collect(), m.orderBy("doc_id").collect()
    assert sorted(rows, key=lambda r: r["doc_id"]) == again and len(rows) == docs.count()
    assert all(len(r["draws"]) <= 3 for r in rows)
    largest = max(r["size"] for r in rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["size"] * len(r["draws"]) for r in own) - own[0]["target"]) <= largest
    shards = Counter(d["shard"] for r in rows for d in r["draws"])
    assert len(shards) == 2**mixing.LEVELS
    odd = mixing.mix(odd_docs).collect()
    assert len(odd) == odd_docs.count() and mixing.mix(no_docs).count() == 0
    assert mixing.mixed_rows(odd_docs).columns == odd_docs.columns


def test_split_tree_is_exact(spark):
    n = {"a": 37, "b": 5, None: 11, "z": 0}
    leaves = mixing.split_tree(spark.createDataFrame(list(n.items()), "source string, n int"), 3).collect()
    for s in n:
        own = sorted((r["first"], r["n"]) for r in leaves if r["source"] == s)
        assert sum(k for _, k in own) == n[s] and all(a + k == b for (a, k), (b, _) in zip(own, own[1:], strict=False))
    per_shard = Counter()
    for r in leaves:
        per_shard[r["shard"]] += r["n"]
    assert max(per_shard.values()) - min(per_shard.values()) <= 1


def test_language_id(spark, odd_docs, no_docs):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    net = language_id.train(docs.where(~held_out()))
    got = language_id.predict(docs.withColumn("__held_out", held_out()), net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    odd = {r["doc_id"]: r for r in language_id.predict(odd_docs, net).collect()}
    assert all(odd[i]["lang_pred"] == "und" for i in (4, 5, 6, 10)) and odd[9]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in odd.values())
    assert language_id.train(no_docs) is None and language_id.predict(odd_docs, None).where("lang_pred != 'und'").count() == 0


def test_toxicity(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train(docs.where(~held_out()), labels.where(~held_out()))
    x = toxicity.score(docs.where(held_out()), model).join(labels, "doc_id").select("score", "toxic").toPandas()
    rank, n1, n0 = x.score.rank(), (x.toxic == 1).sum(), (x.toxic == 0).sum()
    assert (rank[x.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.9
    assert toxicity.score(odd_docs, model).where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.train(no_docs, labels) is None and toxicity.score(odd_docs, None).where("predicted = 1").count() == 0


def test_segments_are_all_maximal_ones():
    def by_hand(scores, lo, hi):
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return by_hand(scores, lo, i) + [(best[0], i, j - 1)] + by_hand(scores, j, hi)

    rng = np.random.default_rng(4)
    for _ in range(40):
        scores = [float(x) for x in rng.normal(-0.3, 1.5, 14)]
        got = toxicity.segments(list(range(14)), scores)
        assert [(round(s, 6), i, j) for s, i, j in got] == [(round(s, 6), i, j) for s, i, j in by_hand(scores, 0, 14)]


def test_url_parts_and_rules(spark):
    urls = {
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"), "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"), "x://b.org": ("b.org", "", None, None), "x://b.org/": ("b.org", "/", "org/", "allow"),
        "http://notexample.com/de/1": ("notexample.com", "/de/1", "com/de/", "block"), "nothing": ("", "", None, None), "http://h?a://b/c": ("h", "", None, None), None: ("", "", None, None), "http://xorg/": ("xorg", "/", None, None),
    }
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for k, want in enumerate(urls.values()):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == want[:3] and got[k]["verdict"] == (want[3] or got[k]["verdict"])
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_model_learns(spark):
    rows = [(k, f"http://{'good' if k % 2 else 'spamwin'}{k}.net/page", "allow" if k % 2 else "block") for k in range(200)]
    model = url_filter.train(spark.createDataFrame(rows, "page_id long, url string, verdict string"))
    assert model.ratio(["goodnew.net/page"])[0] > model.threshold > model.ratio(["spamwinnew.net/page"])[0]


def url_ratios_by_hand(rows, urls):
    """rows: (address, accepted). No context shares its count with another."""
    seen, pad = Counter(), [256] * 5
    for u, ok in rows:
        t = pad + list(u.encode()) + [257]
        seen.update((ok, kind, tuple(t[i - k : i + 1 - kind])) for i in range(5, len(t)) for k in range(6) for kind in (0, 1))
    out = []
    for u in urls:
        t, total = pad + list(u.encode()) + [257], 0.0
        for i in range(5, len(t)):
            for ok in (False, True):
                p = 1 / 256
                for k in range(6):
                    p = (seen[ok, 0, tuple(t[i - k : i + 1])] + 2 * p) / (seen[ok, 1, tuple(t[i - k : i])] + 2)
                total += np.log(p) if ok else -np.log(p)
        out.append(total / (len(t) - 5))
    return out


@pytest.mark.parametrize("head", [4096, 3])
def test_url_counts_are_exact(spark, monkeypatch, head):
    monkeypatch.setattr(url_filter, "HEAD", head, raising=False)
    rng = np.random.default_rng(5)  # far more contexts than 65,536
    word = lambda a, b: bytes(rng.integers(a, b, 30).tolist()).decode()
    rows = [(word(97, 118) if k % 2 else word(102, 123), k % 2 == 1) for k in range(6000)] + [("twice/\u00fc", True)] * 2
    df = spark.createDataFrame([("http://" + u, "allow" if ok else "block") for u, ok in rows], "url string, verdict string")
    aside = {r["u"] for r in df.select(F.substring("url", 8, 99).alias("u")).where(F.pmod(F.xxhash64("u"), F.lit(5)) == 0).collect()}
    urls = [word(97, 123) for _ in range(50)] + [u for u, _ in rows[:20]] + ["", "twice/\u00fc", "\x00\x02\x03"]
    want = url_ratios_by_hand([(u, ok) for u, ok in rows if u not in aside], urls)
    model = url_filter.train(df)
    assert model.ratio(urls) == pytest.approx(want, abs=1e-6)
    pages = df.select(F.lit(1).alias("page_id"), "url").union(spark.createDataFrame([(2, "nothing"), (2, None)], "page_id long, url string"))
    assert url_filter.judge(pages).count() == pages.count()


def test_html(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class="ad box">buy</div><article><h1>Head &amp; tail</h1><p>One <b>bold\n word</b><br><p>Two<script>x="</p>"</script></p><aside>side</aside><div id="comments"><p>reply</p></div></article><footer>&copy; f</footer>'
    plain = lambda k: f"<body><div>Site name</div><p>Story number {k} is told here</p><p>Ends {k}</p><div>All rights kept</div></body>"
    rows = [(1, "http://a.com/x", page), (2, "http://a.com/y", None), (3, "http://a.com/z", ""), (None, None, "<p>lone"), (5, "http://b.com/1", plain(1)), (6, "http://b.com/2", plain(2)), (7, "http://b.com/2", plain(2)), (8, "http://c.com/", "<main>" + page[-60:] + "<a href=\"/cut")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Head & tail\nOne bold word\nTwo" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[None]["text"] == "lone"
    assert got[5]["text"] == "Story number 1 is told here\nEnds 1" and got[6]["text"] == got[7]["text"] == "Story number 2 is told here\nEnds 2"


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_differences_reach_pages_with_articles(spark):
    teaser = lambda k: f"<body><div>Site name</div><div><p>Body {k} begins</p><p>Body {k} ends</p></div><article>Teaser {k}</article></body>"
    inside = lambda k: f"<body><article><p>Follow us</p><p>Story {k}</p><p>More of {k}</p></article></body>"
    rows = [(k, f"http://a.com/{k}", teaser(k)) for k in range(3)] + [(k, f"http://b.com/{k}", inside(k)) for k in range(3, 6)]
    rows += [(6, "http://c.com/1", "<article><p>a</p><p>told twice</p><p>x</p></article>"), (7, "http://c.com/2", "<article><p>b</p><p>told twice</p><p>y</p></article>"), (8, "http://c.com/3", "<article>c</article>")]
    got = extracted(spark, rows)
    assert all(got[k] == f"Body {k} begins\nBody {k} ends\nTeaser {k}" for k in range(3))
    assert all(got[k] == f"Story {k}\nMore of {k}" for k in range(3, 6))
    assert got[7] == "b\ntold twice\ny"  # only one of two neighbours has the article's line


def test_html_pairs_pages_of_one_path_and_beside_copies(spark):
    page = lambda k: "<body>" + "".join(f"<div>Menu line {m}</div>" for m in range(10)) + f"<p>Story {k}</p><p>Ends {k}</p></body>"
    rows = [(k, f"http://a.com/index.php?id={k}", page(k)) for k in range(4)] + [(k, None, page(k)) for k in range(4, 7)]
    rows += [(7, "http://b.com/1", page(7)), (8, "http://b.com/2", page(8)), (9, "http://b.com/3", page(8)), (10, "http://b.com/4", page(8)), (11, "http://b.com/5", page(9))]
    rows += [(12, "http://c.com/1", page(7)), (13, "http://c.com/2", page(7)), (14, "http://d.com/1", "<p>one</p>"), (15, "http://d.com/2", "<p>one</p><p>two</p>")]
    got = extracted(spark, rows)
    assert all(got[k] == f"Story {k}\nEnds {k}" for k in range(9))
    assert got[8] == got[9] == got[10] and got[11] == "Story 9\nEnds 9"
    assert got[12] == got[13] and got[12].startswith("Menu line 0\n")  # nothing but copies on the host
    assert got[14] == "one" and got[15] == "two"  # no page is emptied


def test_alignment_is_longest():
    rng = np.random.default_rng(6)
    for _ in range(30):
        a, b = (rng.integers(0, 5, int(rng.integers(0, 12))).tolist() for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        at = html_text.aligned(a, b)
        picked, j = [a[i] for i in at], iter(b)
        assert len(at) == table[-1][-1] and all(x in j for x in picked)


def test_pipeline(spark, odd_docs):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r["doc_id"] for r in rows}) < 200 and max(Counter(r["doc_id"] for r in rows).values()) <= 3
    left = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, SF)
    assert left.where(F.col("n_tokens") > 0).count() > 0
