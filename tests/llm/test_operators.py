"""Each operator against a brute-force version, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helixframe.llm import decontaminate, exact_dedup, langid, licenses, near_dedup, packing, quality, token_counts, toxicity, warc
from pyspark.sql import functions as F

from .conftest import SCHEMA, words

# 1 token counts


def test_token_counts_equal_the_library(odd, odd_rows):
    tool = token_counts.splicer("piece_bpe_32k.model")
    rows = token_counts.token_counts(odd, chunk_chars=500, overlap_chars=8, with_ids=True).collect()
    assert len(rows) == len(odd_rows)
    want = sorted((str(i), len((t or "").encode()), len(tool.sp.encode(t or ""))) for i, t, *_ in odd_rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) and r.over_limit == (r.n_tokens > 4096) for r in rows)
    assert any(r.n_chunks > 1 for r in rows) and any(r.n_widened > 0 for r in rows)


def test_splices_are_exact_on_random_texts():
    tool, r = token_counts.splicer("piece_bpe_32k.model"), random.Random(2)
    bits = ["a", "the", "é", "😀", "\n", " ", "  ", "x" * 30, "日本", "▁", "1", "<s>", "\t", "."]
    for k in range(400):
        text = "".join(r.choice(bits) for _ in range(r.randrange(200)))
        text = text.replace(" ", "") if k % 4 == 0 else text
        for chunk, overlap in ((16, 4), (40, 8)):
            assert tool.ids(text, chunk, overlap)[0] == tool.sp.encode(text)


def test_token_counts_of_nothing(empty):
    assert token_counts.token_counts(empty).collect() == []


# 2 benchmark decontamination


def _fewest_edits(p, t):
    d, best = list(range(len(p) + 1)), len(p)
    for ch in t:
        n = [0]
        for j in range(1, len(p) + 1):
            n.append(min(d[j - 1] + (p[j - 1] != ch), d[j] + 1, n[-1] + 1))
        d, best = n, min(best, n[-1])
    return best


def test_regions_equal_a_full_alignment():
    r = random.Random(3)
    for _ in range(40):
        item = " ".join(words(r, 30, 500))
        broken = list(item)
        for _ in range(int(len(item) * r.choice([0.02, 0.06, 0.1, 0.14]))):
            at = r.randrange(len(broken))
            r.choice([lambda at=at: broken.__setitem__(at, "q"), lambda at=at: broken.pop(at), lambda at=at: broken.insert(at, "z")])()
        text = " ".join(words(r, 40)) + " " + "".join(broken) + " " + " ".join(words(r, 20))
        index = decontaminate.Index([(0, item)])
        found = {w: e for _, w, e, _, _ in index.find([text])[0]}
        codes = decontaminate.normalised(text)[0].tolist()
        for w, window in enumerate(index.windows):
            least = _fewest_edits(window.tolist(), codes)
            assert (least <= index.budget[w]) == (w in found)
            assert w not in found or found[w] == least


def test_leaks_on_odd_tables(spark, odd, odd_rows, empty):
    item = " ".join(odd_rows[0][1].split()[10:50])
    bench = spark.createDataFrame([(1, item.upper()), (2, None), (3, ""), (None, "short"), (4, "nothing of this kind is anywhere in there, surely not")], "item_id long, text string")
    found = decontaminate.leaks(odd, bench).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, t, *_ in odd_rows if t and item in t or i in (0, 3))
    assert {r.item_id for r in found} == {1}
    kept = decontaminate.without_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - len(found)
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(odd, bench.limit(0)).count() == len(odd_rows)


def test_benchmarks_are_searched_in_blocks(odd, spark, odd_rows, monkeypatch):
    item = " ".join(odd_rows[0][1].split()[10:50])
    bench = spark.createDataFrame([(k, f"filler number {k} with enough letters in it") for k in range(20)] + [(99, item)], "item_id long, text string")
    whole = {r.doc_id for r in decontaminate.leaks(odd, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    assert {r.doc_id for r in decontaminate.leaks(odd, bench).collect()} == whole != set()


# 3 packing


def _gapless(spans):
    end = 0
    for s, n in sorted(spans):
        assert s == end
        end = s + n
    return end


@pytest.mark.parametrize("targets", [None, {"s0": 0.2, "s1": 0.8}])
def test_packing_covers_every_id_once(spark, odd, odd_rows, targets):
    rows = packing.packed(odd.withColumn("doc_id", F.monotonically_increasing_id()), targets=targets, window_tokens=8192, with_ids=True).collect()
    tool = packing.encoder("byte_bpe_50k.json")
    want = sorted([*tool.exact.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in odd_rows)
    docs, seqs, whole = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append((r.start, r.ids))
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        assert r.offset + r.length <= 2048
    assert all(_gapless(v) == next(r.doc_tokens for r in rows if r.doc_id == k) for k, v in docs.items())
    sizes = [_gapless(seqs[k]) for k in sorted(seqs)]
    assert sorted(seqs) == list(range(len(seqs))) and all(n == 2048 for n in sizes[:-1])
    assert sorted([i for _, part in sorted(v) for i in part] for v in whole.values()) == want


def test_windows_hold_the_target_proportions(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(k, " ".join(words(r, r.randrange(20, 400))), f"s{k % 3}") for k in range(300)], "doc_id long, text string, source string")
    rows = packing.packed(docs, window_tokens=4096, sequence_tokens=256).collect()
    total, by = sum(r.length for r in rows), defaultdict(lambda: defaultdict(int))
    share = defaultdict(int)
    for x in rows:
        by[x.window_id][x.source] += x.length
        share[x.source] += x.length / total
    for w in range(max(by)):
        assert sum(by[w].values()) == 4096
        assert all(abs(by[w][s] - 4096 * share[s]) <= 2 for s in share)


def test_cuts_of_random_queues():
    r = random.Random(4)
    for k in range(200):
        n = r.randint(1, 5)
        tokens, shares = [r.randint(0, 3000) for _ in range(n)], [r.random() * (r.random() < 0.8) for _ in range(n)]
        plan, taken = packing.phases(tokens, shares if k % 2 else list(map(float, tokens)), 512), []
        for q in range(n):
            at = 0
            while at < tokens[q]:
                size = min(r.randint(1, 700), tokens[q] - at)
                pieces = packing.cut(at, size, q, plan, 512, 64)
                assert _gapless((b, m) for b, m, _, _ in pieces) == size
                taken += [(p, m) for _, m, p, _ in pieces]
                at += size
        assert _gapless(taken) == sum(tokens)


def test_words_merge_alike_by_rank_and_by_merges():
    """Each token's bytes, merged by lower ranks alone, end in the two parts of its own merge: so rank order gives the merges' ids."""
    import json

    path = token_counts.model_file("byte_bpe_50k.json")
    model = json.load(open(path, encoding="utf-8"))["model"]
    rank = model["vocab"]
    for merge in model["merges"]:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        parts = list(a + b)
        limit = rank[a + b]
        while True:
            pairs = [(rank.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1)]
            low, at = min(pairs, default=(limit, 0))
            if low >= limit:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert parts == [a, b]


def test_sequences_are_whole(odd):
    pieces = packing.packed(odd, with_ids=True)
    for r in packing.sequences(pieces).collect():
        assert len(r.ids) == r.n_tokens <= 2048


def test_packing_of_nothing(empty):
    assert packing.packed(empty).collect() == []


# 4 not-modified revisits

RECORDS = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, body string"


def test_revisits_equal_a_scan(spark):
    r = random.Random(6)
    rows = []
    for k in range(400):
        url = r.choice(["http://www.A.org/x/", "https://a.org/x#top", "http://a.org/x?utm_source=f", "http://a.org/y?b=1&a=2", "http://a.org:80/y?a=2&b=1"]) if r.random() < 0.9 else f"http://b{r.randrange(20)}.org/"
        tag = f'"{r.randrange(3)}"'
        if r.random() < 0.5:
            rows.append((k, url, r.randrange(100), "response", r.choice([200, 200, 404]), {"ETag": tag, "X": str(k), "Content-Length": "9"}, f"b{k}"))
        else:
            rows.append((k, url, r.randrange(100), "revisit", 304, r.choice([{"etag": "W/" + tag, "x": "new", "Content-Length": "0"}, {}]), None))
    got = {x.record_id: x for x in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    keys = dict(spark.createDataFrame(rows, RECORDS).select("record_id", warc.canonical_url(F.col("url"))).collect())
    assert keys[0] and len({keys[k] for k, u, *_ in rows if "a.org" in u.lower()}) == 2
    for k, _, ts, kind, _, h, _ in rows:
        if kind != "revisit":
            continue
        before = [(t, i, g, b) for i, _, t, kd, st, g, b in rows if kd == "response" and st == 200 and keys[i] == keys[k] and (t, i) < (ts, k)]
        x = got[k]
        if not before:
            assert (x.state, x.response_id, x.body) == ("no_response", None, None)
            continue
        _, i, g, b = max(before, key=lambda z: z[:2])
        assert x.response_id == i
        state = "unvalidated" if not h else "resolved" if h["etag"][2:] == g["ETag"] else "changed"
        assert x.state == state
        assert x.body == (b if state != "changed" else None)
        if state == "resolved":
            assert x.headers == {"etag": h["etag"], "x": "new", "content-length": "9"}


def test_revisits_on_odd_tables(spark):
    rows = [(None, None, None, None, None, None, None), (1, None, 5, "revisit", 304, {"ETag": "a"}, None), (2, "http://a/", None, "revisit", 304, None, None), (3, "http://a/", 1, "response", 200, None, "x"), (3, "http://a/", 1, "response", 200, None, "x"), (4, "http://a/", 2, "revisit", 304, None, None), (4, "http://a/", 2, "revisit", 304, None, None), (None, "http://a/", 3, "revisit", 304, {}, None)]
    found = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()
    assert sorted((str(r.record_id), r.state, r.body) for r in found) == [("1", "no_response", None), ("2", "no_response", None), ("4", "unvalidated", "x"), ("4", "unvalidated", "x"), ("None", "unvalidated", "x")]
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_revisits_whose_records_share_names(spark):
    """Header names that differ in case, responses with equal or null identifiers, equal times, a very long body, other columns."""
    long = "x" * 3_000_000
    rows = [
        (1, "http://a/", 1, "response", 200, {"ETag": "old", "etag": "t", "X": "1"}, "a's"), (1, "http://b/", 1, "response", 200, {"ETag": "t"}, "b's"), (None, "http://c/", 1, "response", 200, {"ETag": "t"}, long),
        (2, "http://a/", 2, "revisit", 304, {"ETag": "t", "etag": "t", "Content-Length": "0", "content-length": "1"}, None), (3, "http://b/", 2, "revisit", 304, {"Etag": "t"}, None), (4, "http://c/", 2, "revisit", 304, {"ETAG": "t"}, None),
        (None, "http://d/", 5, "response", 200, None, "d's"), (None, "http://d/", 5, "revisit", 304, None, None), (9, "http://d/", 5, "revisit", 304, None, None),
    ]
    df = spark.createDataFrame(rows, RECORDS).withColumns({"part": F.lit(1), "digest": F.lit("x"), "r": F.lit(2), "salt": F.lit(3), "url_key": F.lit("u")})
    for parts in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert {k: (r.state, r.response_id, r.body) for k, r in found.items()} == {2: ("resolved", 1, "a's"), 3: ("resolved", 1, "b's"), 4: ("resolved", None, long), None: ("unvalidated", None, "d's"), 9: ("no_response", None, None)}
        assert found[2].headers == {"etag": "t", "x": "1"}


# 5 exact dedup


def test_exact_dedup_equals_brute_force(spark, odd, odd_rows, empty):
    r = random.Random(8)
    rows = [*odd_rows, *[(100 + k, r.choice(["a  b", "a b", "a\nb", "c", "", None, "a b "]), None, None, None, None, None, None, None) for k in range(300)]]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(23)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[hashlib.sha256(norm(t).encode()).hexdigest()].append(i)
    want = sorted((str(i), str(min((x for x in groups[h] if x is not None), default=None)), len(groups[h]), h) for i, t, *_ in rows for h in [hashlib.sha256(norm(t).encode()).hexdigest()])
    assert sorted((str(x.doc_id), str(x.keep_id), x.group_size, x.text_sha256) for x in got) == want
    kept = [x for x in got if x.kept]
    assert len(kept) == len(groups) and all(x.doc_id == x.keep_id for x in kept)
    assert exact_dedup.exact_dedup(empty).collect() == []


# 6 toxicity


def _labelled(spark, r, n=600):
    bad = ["vile", "rotten", "lowborn", "lowborne"]
    docs, labels = [], []
    for k in range(n):
        toxic = int(r.random() < 0.2)
        w = words(r, r.randrange(5, 60), 300)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "s"]))
        docs.append((k, " ".join(w)))
        labels.append((k, toxic, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def _plain_toxicity(docs, labels, most=10**9):
    """Score and nearest examples of every (id, text) by plain TF-IDF cosines over all terms, neighbours one by one."""
    from collections import Counter
    from math import log, sqrt

    terms = {i: Counter(toxicity.words_of(t or "")) for i, t in docs}
    df = Counter(w for c in terms.values() for w in c)
    marks = {i: y for i, y in labels if y in (0, 1) and zlib.crc32(str(i).encode()) % 5}
    examples = sorted(i for i in marks if i in terms)
    rate = (sum(marks[i] for i in examples) + 0.5) / (len(examples) + 1)
    n, ones = Counter(w for i in examples for w in terms[i]), Counter(w for i in examples if marks[i] for w in terms[i])

    def factor(w):
        z = abs(ones[w] - n[w] * rate) / sqrt(n[w] * rate * (1 - rate))
        return (log((1 + len(docs)) / (1 + df[w])) + 1) * (max(1, z) if n[w] >= toxicity.LEAST_EXAMPLES else 1)

    vector = {i: {w: (1 + log(k)) * factor(w) for w, k in c.items() if n[w]} for i, c in terms.items()}
    norm = {i: sqrt(sum(x * x for x in v.values())) for i, v in vector.items()}

    def near(i, skip=None):
        own = vector[i]
        cosines = [(sum(x * vector[e].get(w, 0) for w, x in own.items()) / (norm[i] * norm[e]), e) for e in examples if e != skip and norm[i] and norm[e]]
        return sorted(((-s, e) for s, e in cosines if s > 0))[: toxicity.NEAREST]

    def vote(found):
        w = [s * s for s, _ in found]
        return (sum(x * marks[e] for x, (_, e) in zip(w, found)) + toxicity.PRIOR_WEIGHT * rate) / (sum(w) + toxicity.PRIOR_WEIGHT)

    model = toxicity.Model([], [], np.zeros(0), rate)
    model.calibrate([(vote(found), marks[e]) for e in examples if (found := near(e, e))])
    out = {}
    for i, _ in docs:
        found = near(i)
        out[i] = (model.score(vote(found)) if found else rate, [(e, -s) for s, e in found[:3]])
    return out


@pytest.mark.parametrize("postings", [10**6, 900])
def test_toxicity_equals_brute_force(spark, monkeypatch, postings):
    """Term weights, neighbours, votes and calibration, with one shard and with several."""
    docs, labels, truth = _labelled(spark, random.Random(23), 220)
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: fit(*a, shard_postings=postings))
    got = toxicity.toxicity(docs, labels).collect()
    want = _plain_toxicity([tuple(r) for r in docs.collect()], [(i, y) for i, y, _ in truth])
    for r in got:
        score, near = want[r.doc_id]
        assert r.score == pytest.approx(score, abs=1e-6)
        assert [e.similarity for e in r.evidence] == pytest.approx([s for _, s in near], abs=1e-9)


def test_every_word_of_an_example_counts(spark):
    """Near copies of a labelled text are found by words that stand in that text alone, however many other words tell labels."""
    r = random.Random(24)
    tellers = [f"bad{k}" for k in range(200)]
    docs, marks = [], []
    for k in range(400):
        toxic = k % 2
        docs.append((k, " ".join(words(r, 30) + (r.sample(tellers, 20) if toxic else []))))
        marks.append((k, 1, toxic))
    rare = " ".join(f"only{k}" for k in range(40))
    own = next(k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 5)
    docs += [(own, rare), (5000, rare + " and more")]
    marks.append((own, 1, 1))
    rows = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    copy = next(x for x in rows if x.doc_id == 5000)
    assert copy.evidence[0].doc_id == str(own) and copy.evidence[0].similarity > 0.9


def test_block_bounds_lose_no_neighbour():
    r = np.random.default_rng(25)
    example, term = np.divmod(r.choice(700 * 60, 9000, replace=False), 60)
    weight = r.random(9000) + 0.01
    weight[term < 20] = (r.random((term < 20).sum()) + 0.01) * (example[term < 20] < 40)  # terms of few examples
    keep = weight > 0
    example, term, weight = example[keep], term[keep], weight[keep]
    index = toxicity.BlockMaxIndex([b"%d" % k for k in range(60)], np.ones(60), np.ones(60, bool), example, term, weight)
    assert 0 < (index.row >= 0).sum() < 60
    full = np.zeros((700, 60))
    full[example, term] = weight
    full /= np.maximum(1e-300, np.sqrt((full**2).sum(1)))[:, None]
    queries = [(np.sort(r.choice(60, r.integers(0, 9), replace=False)), 0) for _ in range(100)]
    queries = [(t, r.random(len(t)) ** 3) for t, _ in queries]
    skips = [int(r.integers(700)) if r.random() < 0.5 else -1 for _ in queries]
    for (terms, q), skip, (sums, best) in zip(queries, skips, index.nearest(queries, skips)):
        want = np.round(full[:, terms] @ q, 9)
        if skip >= 0:
            want[skip] = 0
        order = sorted((-s, e) for e, s in enumerate(want) if s > 0)[: toxicity.NEAREST]
        assert best.tolist() == [e for _, e in order] and sums == pytest.approx([-s for s, _ in order])


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = _labelled(spark, random.Random(10))
    rows = toxicity.toxicity(docs, labels).collect()
    known = {k: t for k, t, _ in truth}
    held = [x for x in rows if x.held_out]
    assert len(rows) == len(truth) and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in rows)
    assert np.mean([x.predicted == known[x.doc_id] for x in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in rows)


def test_classifiers_on_odd_tables(odd, odd_rows, empty, labels, no_labels):
    for f in (toxicity.toxicity, quality.quality):
        for some in (labels, no_labels):
            rows = f(odd, some).collect()
            assert len(rows) == len(odd_rows) and all(0 <= x.score <= 1 for x in rows)
        assert f(empty, labels).collect() == []


# 7 license scans


def test_licenses_equal_brute_force(odd, odd_rows, spark, empty):
    r = random.Random(11)
    parts = [t for _, t in licenses.TEMPLATES] + ["MIT license", "Apache-License", "GENERAL public\nlicense", "general licence", "mit", "license"]
    texts = [" ".join(r.choice([r.choice(parts), " ".join(words(r, 6)), "\n"]) for _ in range(r.randrange(12))) for _ in range(80)] + [t for _, t, *_ in odd_rows]
    rows = licenses.license_scan(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    sets = [(label, set(find(t))) for label, t in licenses.TEMPLATES]
    spans = [math.ceil(1.25 * len(find(t))) for _, t in licenses.TEMPLATES]
    size = 2 * max(spans)
    dense = lambda block, k: max(len(sets[k][1] & set(block[i : i + spans[k]])) for i in range(max(1, len(block) - spans[k] + 1)))
    holds = lambda block, k: dense(block, k) >= licenses.CONTAINED * len(sets[k][1]) - 1e-9
    for x in rows:
        w = find(texts[x.doc_id])
        base = [(k, v) for p, v in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        found = {v for _, v in base}
        for line in lower(texts[x.doc_id]).split("\n"):
            lw = find(line)
            for s in range(0, max(1, len(lw) - size // 2), size // 2):
                met = [x for k, x in enumerate(sets) if holds(lw[s : s + size], k)]
                found |= {label for label, t in met if not any(t < u for _, u in met)}
        # whatever the lines: every run of a template's span that holds enough of it is met, and matches hold it
        every = {k for k in range(len(sets)) if w and holds(w, k)}
        assert every <= {m.template for m in x.matches}
        for m in x.matches:
            assert m.containment == dense(w[m.first_word : m.first_word + m.n_words], m.template) / len(sets[m.template][1]) >= licenses.CONTAINED - 1e-9
        found |= set(x.labels.split(",")) & {sets[k][0] for k in every}
        assert (x.n_words, x.n_base) == (len(w), len(base))
        assert (x.first_word, x.last_word) == (min((k for k, _ in base), default=None), max((k for k, _ in base), default=None))
        assert (x.base_labels, x.labels) == (",".join(sorted({v for _, v in base})), ",".join(sorted(found)))
        assert 0 <= x.score <= 1
    assert licenses.license_scan(odd).count() == len(odd_rows)
    assert licenses.license_scan(empty).collect() == []


# 8 quality


def test_quality_on_held_out_rows(spark):
    r = random.Random(12)
    docs, marks = [], []
    for k in range(700):
        good = int(r.random() < 0.8)
        w = words(r, r.randrange(20, 80))
        docs.append((k, " ".join(w) + "." if good else r.choice([" | ".join(w), " ".join(x + "%%%" for x in w), " ".join([w[0]] * 40)])))
        marks.append((k, good, 0))
    rows = quality.quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert np.mean([x.predicted == marks[x.doc_id][1] for x in rows if x.held_out]) > 0.95
    assert all(x.predicted == (x.score >= 0.3) for x in rows)


def test_trees_and_scores_equal_plain_ones():
    """Every cut is the best of all cuts, a score is the sigmoid of the entries of its bins, added one by one."""
    r = np.random.default_rng(2)

    def loss(g, h, cuts):
        edges = [0, *cuts, len(g)]
        return -sum(g[a:b].sum() ** 2 / (h[a:b].sum() + 1) for a, b in zip(edges, edges[1:]))

    for _ in range(50):
        g, h = r.normal(size=12), r.random(12) * 3
        allowed = [c for c in range(1, 12) if min(h[:c].sum(), h[c:].sum()) >= quality.LEAST_HESSIAN]
        got = quality.tree(g, h, 2)
        best = min([loss(g, h, []), *(loss(g, h, [c]) for c in allowed)])
        assert abs(loss(g, h, [c for c in range(1, 12) if got[c] != got[c - 1]]) - best) < 1e-9
    x = r.random((400, len(quality.FEATURES)))
    model = quality.Additive(x, (x[:, 2] + x[:, 5] * x[:, 7] > 0.8).astype(float))
    for row, score in zip(x[:40], model.scores(x[:40])):
        bins = [sum(e < v for e in edges) for v, edges in zip(row, model.edges)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins))
        for (a, b), t in zip(model.pairs, model.pair_tables):
            i, j = (bins[f] * quality.COARSE // len(model.tables[f]) for f in (a, b))
            total += t[i * quality.COARSE + j]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9


def test_pairs_learn_what_single_features_cannot():
    r = np.random.default_rng(1)
    x = r.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Additive(x, y)
    assert (0, 1) in model.pairs and np.mean((model.scores(x) > 0.5) == (y == 1)) > 0.95


# 9 near duplicates


def _sets(rows):
    out = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])))
    return out


def _components(rows):
    sets = _sets(rows)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(sets):
        best[find(k)] = min(best.get(find(k), (True, 0)), (i is None, i or 0))
    return [(str(i), len(s), str(None if best[find(k)][0] else best[find(k)][1])) for k, (i, s) in enumerate(sets)]


def test_near_dedup_equals_brute_force(spark, odd_rows, empty):
    r = random.Random(13)
    rows = [(i, t) for i, t, *_ in odd_rows]
    for g in range(6):  # groups of copies with many edits: chains of links, and pairs just under the threshold
        base = words(r, 60 + 40 * g)
        for k in range(25):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = f"edit{r.randrange(99999)}"
            rows.append((1000 + 100 * g + k, " ".join(w)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == sorted(_components(rows))
    one = defaultdict(int)
    for x in got:
        if x.n_shingles:
            one[x.component_id] += x.kept
    assert set(one.values()) == {1}
    assert near_dedup.near_dedup(empty).collect() == []


def test_groups_that_share_a_passage_stay_apart(spark):
    r = random.Random(14)
    passage = words(r, 60)
    rows = [(k, " ".join(passage + words(r, 30))) for k in range(60)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == sorted(_components(rows))


# 10 language


def test_code_lengths_equal_a_plain_model():
    r = random.Random(15)
    texts = {"aa": [b"abracadabra", b"barbara"], "bb": [b"mississippi", b"sip miss"]}
    langs = sorted(texts)
    rows = defaultdict(int)
    for k, lang in enumerate(langs):
        for t in texts[lang]:
            for g in langid._grams([t]):
                rows[k, int(g)] += 1
    lang, gram, n = (np.array(x, np.int64) for x in zip(*[(k, g, c) for (k, g), c in rows.items()]))
    model = langid.Model(langs, lang, gram, n)
    seen = sorted({b for ts in texts.values() for t in ts for b in t})

    def probability(ts, context, b):
        if context is None:
            return 1 / 256
        counts = defaultdict(int)
        for t in ts:
            for i in range(len(context), len(t)):
                if t[i - len(context) : i] == context:
                    counts[t[i]] += 1
        low = lambda x: probability(ts, context[1:] if context else None, x)
        total, kinds = sum(counts.values()), len(counts)
        if not total:
            return low(b)
        if counts.get(b):
            return counts[b] / (total + kinds)
        return kinds / (total + kinds) * low(b) / max(1e-12, 1 - sum(low(x) for x in counts))

    for _ in range(30):
        t = bytes(r.choice(seen) for _ in range(r.randint(1, 12)))
        got = model.code_lengths([t])[0]
        for k, name in enumerate(langs):
            bits = 0.0
            for i in range(len(t)):
                # the longest context that any language has seen
                c = t[max(0, i - 3) : i]
                while c and not any(c in x[:-1] for ts in texts.values() for x in ts):
                    c = c[1:]
                bits -= np.log2(probability(texts[name], c, t[i]))
            assert got[k] == pytest.approx(bits, rel=1e-4)


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([x.lang == x.lang_pred for x in rows if x.held_out]) > 0.95
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in rows)


def test_language_on_odd_tables(odd, odd_rows, empty):
    rows = langid.language_id(odd).collect()
    assert len(rows) == len(odd_rows) and all(0 <= x.score <= 1 for x in rows)
    assert {x.lang_pred for x in rows if x.doc_id in (4, 5, 6, 9)} == {"und"}
    assert {x.lang_pred for x in rows} <= {"und", "en", "de"}
    assert langid.language_id(empty).collect() == []


def _two_languages(spark):
    r = random.Random(16)
    rows = [(k, " ".join(words(r, 200)), "big") for k in range(60)] + [(100 + k, "ångström øre æble", "small") for k in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_shards_of_languages_give_the_scores_of_one(spark, monkeypatch):
    """A language with little text is not crowded out, and languages cut by preceding bytes score as whole ones."""
    docs, rows = _two_languages(spark)
    train = docs.select("lang", "text")
    one = langid.fit(train)
    assert one.langs == ["big", "small"] and len(one.shards) == 1
    plain = {r.doc_id: r for r in langid.predicted(docs, one).collect()}
    assert all(plain[i].lang_pred == lang for i, _, lang in rows)
    many = langid.fit(train, shard_grams=40)
    assert many.langs == one.langs and len(many.shards) > 4
    for r in langid.predicted(docs, many).collect():
        assert r.lang_pred == plain[r.doc_id].lang_pred
        assert (r.score, r.bits_per_byte) == pytest.approx((plain[r.doc_id].score, plain[r.doc_id].bits_per_byte), rel=1e-9)


def test_unlabelled_corpus_passes_the_language_stage(spark):
    docs = spark.createDataFrame([(1, "a text", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    models = langid.fit(langid.training_rows(docs, "doc_id", "text", "lang"))
    assert [r.doc_id for r in langid.with_language(docs, models).collect()] == [1]


def test_ids_of_texts_with_other_white_space():
    tool = packing.encoder("byte_bpe_50k.json")
    r = random.Random(17)
    texts = ["a\tb\tc\n\n\nd", "a\tb  c", "a\r\nb\r\nc\n\nd", "a b\n\nc"]
    texts += ["".join(r.choice(["a", "the", " ", "\n", "\t", "\r\n", " ", "."]) for _ in range(r.randrange(40))) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(tool.encode(text), tool.kind).tolist() == [*tool.exact.encode(text, add_special_tokens=False).ids, 1]


def test_small_sources_have_their_own_quotas(spark):
    r = random.Random(18)
    docs = spark.createDataFrame([(k, " ".join(words(r, 60)), "main" if k % 2 else f"t{k % 94:02d}") for k in range(1500)], "doc_id long, text string, source string")
    rows = packing.packed(docs, window_tokens=16384, sequence_tokens=256).collect()
    seqs, taken, share, total = defaultdict(list), defaultdict(lambda: defaultdict(int)), defaultdict(int), sum(r.length for r in rows)
    for x in rows:
        seqs[x.sequence_id].append((x.offset, x.length))
        taken[x.window_id][x.source] += x.length
        share[x.source] += x.length / total
    assert all(_gapless(seqs[k]) == 256 for k in sorted(seqs)[:-1]) and len(share) == 48 and max(taken) > 8
    for w in range(max(taken)):
        assert sum(taken[w].values()) == 16384
        assert all(abs(taken[w][s] - 16384 * share[s]) <= 8 for s in share)


def test_trees_of_random_sources():
    r = random.Random(19)
    for _ in range(100):
        n = [r.randint(1, 40) for _ in range(r.randint(1, 9))]

        def paths(a, b, n=n):
            if b - a == 1:
                return [[]]
            m = (a + b) // 2
            return [[(sum(n[a:m]), sum(n[m:b]), False), *p] for p in paths(a, m)] + [[(sum(n[a:m]), sum(n[m:b]), True), *p] for p in paths(m, b)]

        tokens = [r.randint(0, 500), sum(n)]
        plan = packing.phases(tokens, list(map(float, tokens)), 32)
        taken = [(p, m) for _, m, p, _ in packing.cut(0, tokens[0], 0, plan, 32, 8)] if tokens[0] else []
        for s, path in enumerate(paths(0, len(n))):
            at = 0
            while at < n[s]:
                size = min(r.randint(1, 20), n[s] - at)
                pieces = packing.cut_tail(at, size, path, 1, plan, 32, 8)
                assert _gapless((b, m) for b, m, _, _ in pieces) == size
                taken += [(p, m) for _, m, p, _ in pieces]
                at += size
        assert _gapless(taken) == sum(tokens)


def test_words_that_are_scattered_are_no_notice(spark):
    """Sentences that hold all words of a short template, but not together, have no label; a notice with a word more has."""
    clean = [
        "The album was released last year; a student at MIT said that the license they work under is unclear.",
        "Apache helicopter pilots are licensed after two tests: version one is written, the other flown under supervision, with a 2 hour limit and 0 errors; the paper license follows.",
        "A CC of the letter went out at 4 pm; by then 0 staff were licensed to work under it.",
        "All rights of way were reserved. No part of the road is open; this was in a publication, which may be reproduced in print without asking for permission.",
    ]
    noted = [("mit", "It is released under the well known MIT License."), ("cc-by", "Text licensed under a CC BY 4.0 deed"), ("apache", "licensed under the Apache Software License, Version 2.0")]
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate([*clean, *(t for _, t in noted)])), "doc_id long, text string")).collect()
    labels = {r.doc_id: r.labels for r in rows}
    assert [labels[k] for k in range(len(clean))] == [""] * len(clean)
    assert all(label in labels[len(clean) + k].split(",") for k, (label, _) in enumerate(noted))


def test_notices_wrapped_over_lines_are_met(spark):
    """Every template broken after every few words, with comment signs, between other lines."""
    import textwrap

    r = random.Random(21)
    texts = []
    for _, t in licenses.TEMPLATES:
        for width in (12, 30, 60):
            lines = ["# " + x for x in textwrap.wrap(t, width, break_on_hyphens=False, break_long_words=False)]
            texts.append("\n".join([" ".join(words(r, 9)) for _ in range(r.randrange(12))] + lines + [" ".join(words(r, 9)) for _ in range(5)]))
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for x in rows:
        number = x.doc_id // 3
        assert licenses.TEMPLATES[number][0] in x.labels.split(",")
        assert any(m.template == number for m in x.matches)


@pytest.mark.parametrize("kind,values", [("int", [7, 9]), ("decimal(10,2)", ["7.25", "9.50"]), ("binary", [b"a", b"b"]), ("date", ["2024-01-02", "2024-01-03"]), ("string", ["x", "y"])])
def test_items_of_any_identifier_are_found_in_blocks(spark, monkeypatch, kind, values):
    from pyspark.sql import functions as F

    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    r = random.Random(8)
    items = [" ".join(words(r, 25)) for _ in values]
    bench = spark.createDataFrame([(str(v) if not isinstance(v, bytes) else v.decode(), t) for v, t in zip(values, items)], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
    docs = spark.createDataFrame([(1, "before " + items[0] + " after"), (2, items[1]), (3, " ".join(words(r, 60)))], "doc_id long, text string")
    found = decontaminate.leaks(docs, bench)
    assert found.schema["item_id"].dataType == bench.schema["item_id"].dataType
    want = {x.text: x.item_id for x in bench.collect()}
    assert {(x.doc_id, x.item_id if not isinstance(x.item_id, bytearray) else bytes(x.item_id)) for x in found.collect()} == {(k + 1, want[t] if not isinstance(want[t], bytearray) else bytes(want[t])) for k, t in enumerate(items)}
    assert [x.doc_id for x in decontaminate.without_leaks(docs, bench).collect()] == [3]


def test_parts_of_items_and_short_items_are_found():
    r = random.Random(22)
    item = " ".join(words(r, 80))
    index = decontaminate.Index([(7, item), (8, "12 + 30 = 42"), (9, "Ann Lee")])
    for _ in range(100):
        s = r.randrange(len(item) - 59)
        text = "before it " + item[s : s + 59].strip() + " and after"
        assert len(item[s : s + 59].strip()) < 59 or {x[0] for x in index.find([text])[0]} == {0}
    texts = ["so 12 +  30 = 42.", "12 + 30 = 421", "by ANN\nLEE, in", "by Joann Lee", "Ann Lee", ""]
    assert [{x[0] for x in found} for found in index.find(texts)] == [{1}, set(), {2}, set(), {2}, set()]
    assert index.find(texts)[0][0][3:] == (3, 16)


def test_repeated_grams_are_counted_in_bounded_memory():
    """A long text of equal letters against items of equal letters and parts of them."""
    import resource

    index = decontaminate.Index([(k, "a" * 300) for k in range(150)] + [(150 + k, "b" * 50 + "a" * (60 + k)) for k in range(50)])
    assert len(index.windows) < 220 and sum(map(len, index.of)) > 1000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = index.find(["a" * 60_000, "b" * 50 + "a" * 70])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000
    assert set(range(150)) <= {x[0] for x in found[0]} and 160 in {x[0] for x in found[1]}


def test_chunks_of_hits_give_the_regions_of_one(monkeypatch):
    r = random.Random(26)
    index = decontaminate.Index([(k, " ".join(words(r, 40, 60))) for k in range(30)])
    texts = [" ".join(words(r, 400, 60)) + " " + "".join(chr(c) for c in index.windows[k]) for k in range(8)]
    whole = index.find(texts)
    assert all(whole)
    monkeypatch.setattr(decontaminate, "MOST_POSTS", 100)
    assert index.find(texts) == whole


def test_near_dedup_of_rows_without_names(spark):
    """Many null and equal identifiers: each meets its own text alone, and a hot identifier is no hot join key."""
    r = random.Random(27)
    base = [words(r, 60) for _ in range(20)]
    rows = []
    for k in range(600):
        w = list(base[k % 20])
        if k % 3:
            w[r.randrange(60)] = f"edit{k}"
        rows.append((None if k % 2 else 7, " ".join(w)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == sorted(_components(rows))
    assert sum(x.kept for x in got) == 20


def test_components_of_hubs_and_chains(spark):
    """A hub of 500 nodes in the middle of the order, one that is its component's least node, and a chain."""
    from helixframe.llm.components import components

    r = random.Random(28)
    edges = [(1000, k) for k in range(750, 1250) if k != 1000] + [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(2000, 2040)] + [(5, 5)]
    r.shuffle(edges)
    got = {x.node: x.root for x in components(spark.createDataFrame([e if r.random() < 0.5 else e[::-1] for e in edges], "u long, v long").repartition(5)).collect()}
    assert got == {k: 750 for k in range(750, 1250)} | {k: 0 for k in range(300)} | {k: 2000 for k in range(2000, 2041)}


def test_rows_with_a_language_are_the_same_in_one_shard_and_in_many(spark):
    """``und`` may be a learned language: its rows go whether the model is one shard or several."""
    rows = [(k, "the cat sat on the mat and ran" if k % 2 else "zq xw vj kz qx", "en" if k % 2 else "und") for k in range(20)]
    docs = spark.createDataFrame([*rows, (20, "12 34", None), (21, None, None)], "doc_id long, text string, lang string")
    train = langid.training_rows(docs, "doc_id", "text", "lang")
    one, many = langid.fit(train), langid.fit(train, shard_grams=20)
    assert len(one.shards) == 1 and len(many.shards) > 1
    kept = [sorted(tuple(r) for r in langid.with_language(docs, m).collect()) for m in (one, many)]
    assert kept[0] == kept[1] and {r[0] for r in kept[0]} == set(range(1, 20, 2))
    assert langid.with_language(docs, many).columns == docs.columns
