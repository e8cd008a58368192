"""Every contracted query against a brute-force version on awkward rows, and on the smallest given tables."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import __spark_entry__
from tallyward.llm.token_spans import VOCABULARY, Encoder, section_counts, weights

GIVEN = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()
WORD = re.compile("[^\x20\x09-\x0d]+")


def query(prefix):
    return next(f for n, f in QUERIES.items() if n.startswith(prefix + "_"))


def rows_of(frame, *columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


@pytest.fixture(scope="module", params=["awkward", "given"])
def case(request, spark, sf_dir):
    folder = sf_dir if request.param == "awkward" else GIVEN
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    return folder, [(r.doc_id, r.text, r.source) for r in docs]


def test_op1_bytes(spark, case):
    folder, docs = case
    texts = [(d, (t or "").encode()) for d, t, _ in docs]
    seen = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = Counter()
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        want[d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert rows_of(query("op1")(spark, folder), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op2_mix(spark, case):
    folder, docs = case
    rows = query("op2")(spark, folder).collect()
    sizes = Counter()
    for d, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    stopped, targets = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        level = rest / max(1, sum(weight[s] for s in names if s not in stopped))
        targets = {s: 3.0 * sizes[s] if s in stopped else level * weight[s] for s in names}
        above = {s for s in names if targets[s] > 3 * sizes[s]}
        if not above:
            break
        stopped |= above
    source_of = Counter((d, len(WORD.findall(t or "")), sizes[s], round(targets[s], 6)) for d, t, s in docs)
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in rows) == source_of
    assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in rows)
    taken, largest = Counter(), Counter()
    for r in rows:
        taken[r.source_size, r.target] += r.taken
        largest[r.source_size, r.target] = max(largest[r.source_size, r.target], r["size"])
    assert all(abs(t - target) <= 2 * largest[size, target] + 1 for (size, target), t in taken.items())
    again = query("op2")(spark, folder)
    assert rows_of(again, "doc_id", "size", "taken") == Counter((r.doc_id, r["size"], r.taken) for r in rows)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_op4_secrets(spark, case):
    folder, docs = case
    want = Counter()
    for d, t, _ in docs:
        t = t or ""
        found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        spans = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
        n = Counter(f[1] for f in found)
        want[d, n[0], n[1], n[2], hashlib.sha256(spans.encode()).hexdigest(), spans] += 1
    columns = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert rows_of(query("op4")(spark, folder), *columns) == want


def test_op5_simhash(spark, case):
    folder, docs = case
    prints = []
    for _, t, _ in docs:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {g: min((docs[i][0] for i in range(len(docs)) if group[i] == g and docs[i][0] is not None), default=None) for g in set(group)}
    want = Counter((docs[i][0], format(prints[i], "016x"), least[group[i]]) for i in range(len(docs)))
    assert rows_of(query("op5")(spark, folder), "doc_id", "fingerprint", "component_id") == want


def test_op7_language(spark, case):
    folder, docs = case
    import zlib

    rows = query("op7")(spark, folder).collect()
    held = Counter((d, zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0) for d, _, _ in docs)
    assert Counter((r.doc_id, r.held_out) for r in rows) == held
    langs = {r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()} - {None}
    assert all(0 <= r.score <= 1 and r.lang_pred in langs | {"und"} for r in rows)
    blank = Counter(d for d, t, _ in docs if not any(c.isalpha() for c in t or ""))
    assert Counter(r.doc_id for r in rows if r.lang_pred == "und") == blank


def test_op7_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in query("op7")(spark, folder).collect() if r.held_out]
    assert np.mean([r.lang_pred == true[r.doc_id] for r in held]) >= 0.97


def test_op8_words(spark, case):
    folder, docs = case
    words = [(d, WORD.findall(t or "")) for d, t, _ in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - 49 if d is not None else 0):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, d), d)
    want = Counter()
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 49 if d is not None else 0):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert rows_of(query("op8")(spark, folder), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_op9_pages(spark, case):
    folder, _ = case
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    first = {}
    for p, html in pages:
        ids = [x for x in (first.get(html), p) if x is not None]
        first[html] = max(ids) if ids else None
    want = Counter()
    for p, html in pages:
        digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
        same = first[html] == p
        want[p, len(html), digest, "response" if same else "revisit", None if same else first[html]] += 1
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows_of(query("op9")(spark, folder), *columns) == want


def test_op10_leaks(spark, case):
    folder, docs = case
    items = [(r.item_id, WORD.findall((r.text or "").lower())) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = {}
    for d, t, _ in docs:
        w = WORD.findall((t or "").lower())
        for item, v in items:
            k = min(5, len(v))
            if not v or item is None:
                continue
            parts = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            own = Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1))
            n = sum(own.values())
            inside = np.concatenate(([0], np.cumsum([p in own for p in parts]))) if parts else np.zeros(1, int)
            best, size = None, min(n, len(parts))  # of shorter documents the whole
            for s in range(len(parts) - size + 1):
                if inside[s + size] - inside[s] >= n / 2:
                    same = sum((own & Counter(parts[s : s + size])).values())
                    if same / (size + n - same) >= 0.8 and (best is None or same > best[1]):
                        best = (s, same, same / (size + n - same))
            if best:
                want[d, item, best[0], size + k - 1, round(best[2], 9)] = 1
    rows = query("op10")(spark, folder).collect()
    assert {(r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in rows} == set(want)


@pytest.mark.parametrize("rule", ["first", "last", "share"])
def test_op3_token_spans(spark, case, rule):
    folder, docs = case
    encoder = Encoder(open(VOCABULARY, "rb").read())
    found = {}
    for r in section_counts(spark.read.parquet(f"{folder}/documents.parquet"), rule=rule).collect():
        key = (r.doc_id, r.section, r.start, r.end)
        found[key] = found.get(key, 0) + r.n_tokens
    want = {}
    for d, t, _ in docs[:120]:
        t, at, spans = t or "", 0, []
        if not t.isascii():
            continue  # characters of several bytes: see test_spans_of_split_characters
        for token in encoder.encoding.encode_ordinary(t):
            spans.append((at, len(encoder.encoding.decode_single_token_bytes(token))))
            at += spans[-1][1]
        at = 0
        for number, line in enumerate(re.findall(r"[^\n]*\n|[^\n]+", t)):
            end, n = at + len(line), 0
            for start, size in spans:
                inside = min(end, start + size) - max(at, start)
                n += {"first": at <= start < end, "last": at < start + size <= end, "share": max(0, inside) / size}[rule]
            want[d, number, at, end] = want.get((d, number, at, end), 0) + n
            at = end
    assert {k: round(v, 6) for k, v in found.items() if k in want} == {k: round(v, 6) for k, v in want.items()}


def test_spans_of_split_characters():
    encoder = Encoder(open(VOCABULARY, "rb").read())
    text = "a\U0001f600éb"
    first, last = encoder.spans(text)
    assert first[0] == 0 and last[-1] == 3 and (np.diff(first) >= 0).all() and (last >= first).all()
    for rule in ("first", "last", "share"):
        assert round(float(weights(first, last, len(text), rule)[-1]), 9) == len(first)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("op") or n == "pipeline"))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []
