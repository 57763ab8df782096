"""The registered queries over whole tables against SQL or brute force."""

import hashlib
import html
import re
import zlib
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_operators import url_ratios_by_hand

from tessera.llm import bpe, html_text, language_id, mixing, queries, toxicity
from tessera.llm.common import held_out, table

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns) and len(ours) == 1000
    assert sorted(map(str, ours[cols].values.tolist())) == sorted(map(str, theirs[cols].values.tolist()))


def documents(spark, sf):
    return {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}


def aside(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op1_is_the_network_on_all_windows(spark):
    docs, net = documents(spark, SMALL), language_id.train(table(spark, SMALL, "documents").where(~held_out()))
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, SMALL).collect()}
    assert got.keys() == docs.keys()
    conv = net.conv.reshape(max(language_id.WIDTHS), language_id.EMBED, -1)
    for i, d in list(docs.items()):
        text = (d["text"] or "").encode()
        total = np.zeros(len(net.langs))
        for at in range(0, len(text), language_id.WINDOW):
            part = text[at : at + language_id.WINDOW]
            e = net.embed[np.frombuffer(part.ljust(language_id.WINDOW, b"\0"), np.uint8)]
            pooled = []
            for k, w in enumerate(language_id.WIDTHS):
                own = slice(k * language_id.FILTERS, (k + 1) * language_id.FILTERS)
                spans = range(language_id.WINDOW - max(language_id.WIDTHS) + 1)
                pooled.append(np.max([np.tensordot(e[p : p + w], conv[:w, :, own], 2) for p in spans], 0) + net.bias[own])
            z = np.maximum(np.concatenate(pooled), 0) @ net.out + net.out_bias
            total += len(part) * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
        p = np.exp(total / max(len(text), 1) - np.logaddexp.reduce(total / max(len(text), 1)))
        letters = any(c.isalpha() for c in d["text"] or "")
        assert got[i]["held_out"] == aside(i) and got[i]["score"] == pytest.approx(p.max() if letters else 0, abs=1e-4)
        assert got[i]["lang_pred"] == ("und" if not letters else net.langs[p.argmax()])


def best_segments(score):
    """Maximal segments by their definition: the best one, and those on both sides of it."""
    out, todo = [], [(0, len(score))]
    while todo:
        lo, hi = todo.pop()
        if hi <= lo or not (score[lo:hi] > 0).any():
            continue
        total = np.r_[0, np.cumsum(score[lo:hi])]
        gain = total[1:] - np.minimum.accumulate(total)[:-1]
        j = int(gain.argmax())
        i = int(total[: j + 1].argmin())
        out.append((gain[j], lo + i, lo + j))
        todo += [(lo, lo + i), (lo + j + 1, hi)]
    return out


def test_op2_scores(spark):
    docs, tokens = documents(spark, SF), lambda t: toxicity.TOKEN.findall((t or "").lower())
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect() if not aside(r["doc_id"])}
    learnt = [i for i in labels if i in docs]
    fold = {r["doc_id"]: r["f"] for r in table(spark, SF, "documents").select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibration")), F.lit(4)).alias("f")).collect()}
    counts = Counter(), Counter()
    for i in learnt:
        if fold[i] != 3:
            counts[labels[i]].update(set(tokens(docs[i]["text"])))
    a, b = sum(counts[1].values()), sum(counts[0].values())
    weights = {}
    for w in counts[0].keys() | counts[1].keys():
        prior = toxicity.PRIOR * (counts[1][w] + counts[0][w])
        up, down = counts[1][w] + prior, counts[0][w] + prior
        d = np.log(up / (a + toxicity.PRIOR * (a + b) - up)) - np.log(down / (b + toxicity.PRIOR * (a + b) - down))
        error = np.sqrt(1 / up + 1 / down)
        if abs(d / error) >= toxicity.Z_MIN:
            weights[w] = d - np.sign(d) * min(toxicity.Z_BOUND * error, abs(d))
    scores = {i: np.array([weights.get(w, toxicity.GAP) for w in tokens(r["text"])]) for i, r in docs.items()}
    best = [(max((s for s, _, _ in best_segments(scores[i])), default=0.0), max(len(scores[i]), 1)) for i in learnt if fold[i] == 3 and not labels[i]]
    hits = [s for s, _ in best if s > 0]
    rate, k = (len(hits) + 1) / (sum(hits) + 1), (len(hits) + 0.5) / sum(n for _, n in best)
    evidence = {}
    for i, s in scores.items():
        e = [k * len(s) * np.exp(-rate * x) for x, _, _ in best_segments(s)]
        evidence[i] = sum(-np.log10(max(x, 1e-300)) for x in e if x < toxicity.E_MAX)
    model = toxicity.train(table(spark, SF, "documents").where(~held_out()), table(spark, SF, "labels").where(~held_out()))
    assert model.weights == pytest.approx(weights) and (model.rate, model.k) == pytest.approx((rate, k))
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        p = 1 / (1 + np.exp(-np.clip(model.slope * np.log1p(evidence[i]) + model.offset, -30, 30)))
        assert r["held_out"] == aside(i) and r["score"] == pytest.approx(p, abs=1e-6) and r["predicted"] == (r["score"] >= 0.3)
    assert model.slope > 0


def test_op2_handles_repeated_ids_and_ties(spark):
    rows = [(k % 7, ("bad words here " if k % 2 else "good words there ") * 3) for k in range(400)] + [(None, "bad"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("toxic", F.lit(5))
    labels = spark.createDataFrame([(k, k % 2) for k in range(7)] + [(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == 403
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.train(docs, labels.where("toxic = 0")) is None


def test_op3_targets_and_draws(spark):
    size = {i: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for i, r in documents(spark, SF).items()}
    sources = Counter()
    for s, n in size.values():
        sources[s] += n
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}
    full = set()
    while True:
        rest = sum(sources.values()) - sum(3 * sources[s] for s in full)
        want = {s: 3.0 * sources[s] if s in full else rest * weight[s] / sum(weight[x] for x in sources if x not in full) for s in sources}
        over = {s for s in want if s not in full and want[s] > 3 * sources[s]}
        if not over:
            break
        full |= over
    rows, again = (queries.op3_mixing(spark, SF).collect() for _ in range(2))
    assert sorted(rows) == sorted(again) and {r["doc_id"] for r in rows} == size.keys() and len(rows) == len(size)
    taken = Counter()
    for r in rows:
        s, n = size[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sources[s]) and r["target"] == pytest.approx(want[s])
        assert r["taken"] == n * len([x for x in r["shards"].split(",") if x]) and r["taken"] <= 3 * n
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(n for x, n in size.values() if x == s) for s in sources)


def test_mixing_grows_with_the_rows(spark, monkeypatch):
    docs = table(spark, SMALL, "documents")
    assert mixing.sizes(1000) == (mixing.BLOCKS, mixing.LEVELS) and mixing.sizes(10**10) == (1 << 21, 18)
    for name, n in (("BLOCK_ROWS", 1), ("BLOCKS", 1), ("SHARD_ROWS", 3), ("WRITTEN_LEVELS", 2)):
        monkeypatch.setattr(mixing, name, n)
    m = mixing.mix(docs).collect()
    assert len({d["shard"] for r in m for d in r["draws"]}) > 32 and len(m) == docs.count()
    for s in {r["row"]["source"] for r in m}:
        own = [r for r in m if r["row"]["source"] == s]
        assert abs(sum(r["size"] * len(r["draws"]) for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def html_by_hand(rows):
    """rows: (page_id, url, html). Everything but the alignment of two pages is done plainly."""
    pages = []
    for i, url, h in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        pages.append((host, path, url or "", i, html_text.blocks(h or "")))
    out, site, counts = {}, set(), Counter()
    contents = {}
    for host, path, url, i, lines in sorted((p for p in pages if p[4]), key=lambda p: p[:4]):
        contents.setdefault((host, tuple(lines)), (path, url, i))
    found = {}
    for host, own in groupby(contents, key=lambda c: c[0]):
        own = [c[1] for c in own]
        for k, lines in enumerate(own):
            near = [own[j] for j in range(k - html_text.NEAR, k + html_text.NEAR + 1) if 0 <= j < len(own) and j != k]
            number = {x: n for n, x in enumerate({(t, kind) for page in [lines, *near] for t, _, kind in page})}
            keys = lambda page: [number[t, kind] for t, _, kind in page]  # noqa: E731, B023
            found[host, lines] = html_text.votes(keys(lines), [keys(p) for p in near]), len(near)
            if near:
                for (t, inside, kind), v in zip(lines, found[host, lines][0], strict=True):
                    counts[kind, inside, t, v > 0] += 1
    n, hit = (sum(c for (_, inside, _, v), c in counts.items() if inside and (v or not only)) for only in (False, True))
    base = (hit + 1) / (n + 100)
    for kind in {k for k, inside, _, _ in counts if not inside and " " in k}:
        mine = {key: c for key, c in counts.items() if key[0] == kind and not key[1]}
        n, hit = sum(mine.values()), sum(c for key, c in mine.items() if key[3])
        expected = max(html_text.TIMES * base, html_text.LEAST) * n
        if hit - expected > html_text.ERRORS * expected**0.5 and len({key[2] for key in mine}) <= html_text.DISTINCT * n:
            site.add(kind)
    for host, _, _, i, lines in pages:
        gone = set()
        if lines:
            votes, n = found[host, tuple(lines)]
            gone = set(html_text.site_lines(votes, [x for _, x, _ in lines], [kind in site and not x for _, x, kind in lines], n))
        out[i] = "\n".join(t for k, (t, _, _) in enumerate(lines) if k not in gone)
    return out


def test_op4_is_the_difference_from_the_nearest_pages(spark):
    rows = [tuple(r) for r in table(spark, SF, "pages").select("page_id", "url", "html").collect()]
    got = {r["page_id"]: r for r in queries.op4_html_text(spark, SF).collect()}
    want = html_by_hand(rows)
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())
    clean = lambda t: " ".join(html.unescape(re.sub("<[^>]*>", "", t.replace("<br>", " "))).split())
    for i, _, h in rows:
        article = re.search("(?s)<article>(.*)</article>", h)[1]
        assert got[i]["text"] == "\n".join(x for x in map(clean, re.split("</?(?:p|h1)>", article)) if x)


def test_op4_differencing_alone(spark):
    """Without any class that tells, on pages whose adverts repeat: the lines go, and so do all of their kind."""
    def page(k):
        return f"<body><div class=box>Advert {k % 3 if k % 4 else k}</div><article><p>Story {k}</p><p>Ends {k}</p></article></body>"
    rows = [(k, f"http://a.com/{k:04}", page(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df, marks=frozenset()).collect()}
    assert got == {k: f"Story {k}\nEnds {k}" for k in range(300)}
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    without = html_text.extract(pages, marks=frozenset()).toPandas().set_index("page_id")["text"]
    marked = html_text.extract(pages).toPandas().set_index("page_id")["text"]
    assert 100 < (without == marked).sum() < 2500 and all(a.endswith(b) for a, b in zip(without, marked[without.index], strict=True))


def test_op4_keeps_what_looks_like_marks(spark):
    body = '<div class="ad-hoc">Made for it</div><h2 id="search-results">Results</h2><p>Now <span class="share price">12.50</span> each</p><section class="header-story">Told</section>'
    rows = [(1, "http://a.com/1", f"<body>{body}<article>Teaser</article></body>"), (2, "http://b.com/1", f"<article><header><h1>Title</h1></header>{body}<div class='comment'>Mine</div><div role=navigation>Menu</div></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("key", F.lit("x")).withColumn("lines", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    want = "Made for it\nResults\nNow 12.50 each\nTold"
    assert got == {1: want + "\nTeaser", 2: "Title\n" + want}
    assert html_text.extract(df.limit(0)).count() == 0


def test_long_pages_align_in_bounded_memory():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 50, 30_000).tolist()
    b = [x for x in a if rng.random() < 0.9]
    at = html_text.aligned(a, b)
    assert [a[k] for k in at] == b


def test_op5_is_tiktoken(spark):
    enc = bpe.encoding(P.path(queries.RANKS), P.PATTERN)
    docs = documents(spark, SF)
    for r in queries.op5_byte_bpe(spark, SF).collect():
        text = docs[r["doc_id"]]["text"] or ""
        ids = enc.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op5_takes_any_length(spark):
    """Runs of one character, where merging leaves as many of its longest token as fit, and texts over LONG."""
    enc = bpe.encoding(P.path(queries.RANKS), P.PATTERN)
    n = 2_000_000
    word = "ein Wort und noch eins, 12 mal "
    texts = [" " * n, "\n" * n + "x", "x" * n, "a\n" + " " * n + "b", "　" * (n // 2), word * 20_000, " \n" * (n // 2) + "it's"]
    rows = {r["doc_id"]: r for r in bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), P.path(queries.RANKS), P.PATTERN).collect()}
    one = lambda t: enc.encode_ordinary(t)
    assert all(bytes(rows[k]["decoded"]).decode() == t for k, t in enumerate(texts))
    assert rows[0]["ids"] == one(" ") * n and rows[1]["ids"] == one("\n") * (n - 1) + one("\nx")
    assert rows[2]["ids"] == one("xx") * (n // 2) and len(one("xx")) == 1
    assert rows[3]["ids"] == one("a") + enc._encode_single_piece(("\n" + " " * (n - 1)).encode()) + one(" b")
    small = one(word * 3)
    assert rows[5]["ids"] == small[: len(one(word)) - 1] + (one(word * 2)[len(one(word)) - 1 : len(one(word * 2)) - 1]) * 19_999 + one(word * 2)[-1:]
    assert rows[6]["ids"][:4] == one(" ") + one("\n") + one(" ") + one("\n") and rows[6]["ids"][-2:] == one("it's")


def test_op9_verdicts(spark):
    pages = table(spark, SF, "pages").select("page_id", "url").collect()
    got = {r["page_id"]: r for r in queries.op9_url_filter(spark, SF).collect()}
    lower = lambda t: re.sub("[A-Z]", lambda c: c[0].lower(), t)
    parts, rules = {}, {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    for r in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        parts[r["page_id"]] = host, path, max(fits, key=len, default=None), lower(re.sub(r"(?s)^.*?://", "", r["url"] or ""))
    rows = [(u, rules[rule] == "allow") for _, _, rule, u in parts.values() if rule]
    away = {r["u"] for r in spark.createDataFrame([(u,) for u in {p[3] for p in parts.values()}], "u string").where(F.pmod(F.xxhash64(F.col("u").cast("binary")), F.lit(5)) == 0).collect()}
    addresses = sorted({p[3] for p in parts.values()})
    ratio = dict(zip(addresses, url_ratios_by_hand([x for x in rows if x[0] not in away], addresses), strict=True))
    kept = [(round(ratio[u] * 100), ok) for u, ok in rows if u in away]
    ones = sum(ok for _, ok in kept), sum(not ok for _, ok in kept)
    bins = sorted({b for b, _ in kept})
    wrong = [(sum(ok for b, ok in kept if b in bins[:i]) / ones[0] + sum(not ok for b, ok in kept if b in bins[i:]) / ones[1], i) for i in range(len(bins) + 1)]
    at = min(wrong)[1]
    low = (bins[at - 1] + 0.5) / 100 if at else -np.inf
    high = (bins[at] - 0.5) / 100 if at < len(bins) else np.inf
    limit = 0.0 if low <= 0 <= high else high if low == -np.inf else low if high == np.inf else (low + high) / 2
    assert got.keys() == parts.keys()
    for i, (host, path, rule, u) in parts.items():
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if rule or abs(ratio[u] - limit) > 1e-6:
            assert got[i]["verdict"] == (rules[rule] if rule else "allow" if ratio[u] >= limit else "block")
    assert any(rule is None for _, _, rule, _ in parts.values())


def test_op9_odd_rows(spark):
    long = "http://x.net/" + "abc/" * 5000
    rows = [(k, u) for k, u in enumerate(["http://a.org/1", "http://a.org/1", "http://b.com/de/2", long, long, None, "", "no scheme"])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit("mine")).withColumn("u", F.lit(2))
    from tessera.llm import url_filter

    got = url_filter.judge(df).collect()
    assert len(got) == 8 and len({r["verdict"] for r in got if r["page_id"] in (3, 4)}) == 1 and {r["host"] for r in got} == {"a.org", "b.com", "x.net", ""}


def test_judged_quality_plans_quickly(spark):
    from tessera.llm import quality

    docs = table(spark, SMALL, "documents")
    q = queries.op7_quality(spark, SMALL)
    n = q.where("kept and n_words > 100").join(docs, "doc_id").where("lang = 'en'").groupBy("source").agg(F.sum("n_repeat_words")).count()
    assert n > 0 and quality.judge(docs).groupBy("kept", "base_failed").count().count() == 3
    assert quality.passing(docs).where("length(text) > 200").count() <= q.where("kept").count()
