"""Exact, near, line and suffix de-duplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from costproof.llm import exact_dedup, line_dedup, simhash, suffix_dedup
from costproof.llm.components import components
from costproof.llm.suffix_arrays import agrees, suffix_array

DOCS = "doc_id long, text string, key string, uid long, h1 string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "k", 7, "x") for i, t in zip(ids, texts, strict=True)], DOCS)


def odd_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    body = " ".join(rng.choice(words) for _ in range(300))
    return [
        None, "", " ", "\t \n", "one", "one", "One", "one  two\tthree", "one two three", body, body + " ", body,
        body.replace("w1 ", "W1 "), body + " tail", "é" * 5000, "é" * 4999 + "e", "x" * 9000, "x" * 9001,
    ]


def test_exact_groups_match_brute_force_at_any_block_size(spark):
    texts = odd_texts()
    clean = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    docs = frame(spark, texts)
    for size in (1, 7, 4096):
        if size == 1:
            docs_here, clean_here = frame(spark, texts[:9]), clean[:9]
        else:
            docs_here, clean_here = docs, clean
        got = {r["doc_id"]: r for r in exact_dedup.groups(docs_here, block_bytes=size).collect()}
        assert len(got) == len(clean_here)
        for i, t in enumerate(clean_here):
            same = [j for j, u in enumerate(clean_here) if u == t]
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (same[0], len(same), same[0] == i)
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_keeps_one_row_of_each_text_with_all_columns(spark):
    docs = frame(spark, ["a", "a", "b", None, "", "b"], [2, 1, None, None, 9, None])
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect()) == [("1", "a"), ("9", ""), ("None", "b")]
    assert exact_dedup.dedup(docs.limit(0)).count() == 0
    assert exact_dedup.groups(docs.limit(0)).count() == 0


def fingerprint_of(text, words):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(nodes, linked):
    low = {}
    for start in sorted(nodes):
        if start in low:
            continue
        todo = [start]
        low[start] = start
        while todo:
            a = todo.pop()
            for b in nodes:
                if b not in low and linked(a, b):
                    low[b] = start
                    todo.append(b)
    return low


def test_fingerprints_match_the_definition(spark, monkeypatch):
    for text in odd_texts():
        for words in (4, 5):
            got = simhash.fingerprint(text.encode() if text is not None else None, words)[0]
            assert got & (2**64 - 1) == fingerprint_of(text, words)
    monkeypatch.setattr("costproof.llm.texts.CHUNK", 50)
    text = odd_texts()[9]
    assert simhash.fingerprint(text.encode())[0] & (2**64 - 1) == fingerprint_of(text, 4)


def test_linked_fingerprints_match_all_pairs(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = set(centres) | {0, 1, 3, 2**64 - 1}
    for c in centres:
        for _ in range(40):
            prints.add(c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))) & (2**64 - 1))
    prints = sorted(p - 2**64 if p >> 63 else p for p in prints)
    points = spark.createDataFrame([(p,) for p in prints], "fp long")
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4
    want = smallest_reachable(prints, near)
    got = {r["fp"]: r["root"] for r in simhash.linked(points).collect()}
    assert set(got) == set(prints)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(got) == groups(want)


def test_near_groups_and_near_dedup_on_odd_texts(spark):
    texts = odd_texts()
    got = {r["doc_id"]: r for r in simhash.near_groups(frame(spark, texts)).collect()}
    prints = {i: fingerprint_of(t, 4) for i, t in enumerate(texts)}
    want = smallest_reachable(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {i: (int(r["fingerprint"], 16), r["component_id"]) for i, r in got.items()} == {
        i: (prints[i], want[i]) for i in prints
    }
    kept = simhash.near_dedup(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "key", "uid", "h1"]
    ids = {r["doc_id"] for r in kept.collect()}
    assert {0, 4, 9} <= ids and not ids & {1, 2, 3, 5, 6, 10, 11}
    assert simhash.near_dedup(frame(spark, texts).limit(0)).count() == 0
    assert simhash.near_groups(frame(spark, texts).limit(0)).count() == 0
    twins = frame(spark, ["same words here now", "same words here now"], [None, None])
    assert simhash.near_dedup(twins).count() == 1
    assert {r["component_id"] for r in simhash.near_groups(twins).collect()} == {None}


def test_components_of_a_long_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (5000, 5001), (5001, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(50)}) == 1
    assert got[5000] == got[5001] and len({got[0], got[1000], got[5000]}) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_boilerplate_lines_by_site(spark):
    rows = [(i, "s", f"head\nown {i}\n\nfoot\nfoot", None, None) for i in range(4)]
    rows += [(10, "s", None, None, None), (11, None, "head\nx", None, None), (12, "t", "head", None, None), (13, "t", "", None, None)]
    pages = spark.createDataFrame(rows, "doc_id long, source string, text string, site string, kept string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(pages, ratio=0.5).collect()}
    assert out == {0: "own 0\n", 1: "own 1\n", 2: "own 2\n", 3: "own 3\n", 10: None, 11: "head\nx", 12: "head", 13: ""}
    assert line_dedup.drop_boilerplate(pages, ratio=0.9).where("text like '%head%'").count() == 6
    assert line_dedup.drop_boilerplate(pages.limit(0)).count() == 0
    assert line_dedup.drop_boilerplate(pages).columns == pages.columns


def test_suffix_arrays_sort_and_compare():
    rng = random.Random(2)
    for _ in range(150):
        data = bytes(rng.choice(b"ab\x00\xff"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 70)))
        order = suffix_array(data)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        order = order[order <= len(data) - 9]
        if len(order) > 1:
            same = [data[a : a + 9] == data[b : b + 9] for a, b in zip(order[1:], order[:-1], strict=True)]
            assert agrees(data, order, 9).tolist()[1:] == same
    assert suffix_array(b"").tolist() == []


def without_repeats(texts, length):
    seen, out = {}, []
    data = [(t or "").encode() for t in texts]
    for b in data:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), kept, len(re.findall(b"\x01+", bytes(gone)))))
    return out


@pytest.mark.parametrize("shard_contexts", [20_000, 1])
def test_repeated_strings_are_cut_as_brute_force_cuts_them(spark, shard_contexts, monkeypatch):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage, body = noise(260), noise(900)
    texts = [None, "", "short", body, body, body[:400] + "!" + body[400:], noise(500) + passage + noise(300)]
    texts += [passage + noise(150), noise(90) + passage, passage[:150], "ab" * 400, "z" * 1000, noise(700) * 2]
    texts += [noise(40) + passage[20:230] + noise(40) for _ in range(5)]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    docs = frame(spark, texts)
    for length in (200, 67):
        out = suffix_dedup.remove_repeats(docs, length=length, filter_bits=16, shard_contexts=shard_contexts)
        got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in out.collect()}
        assert [got[i] for i in range(len(texts))] == without_repeats(texts, length)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_parts_of_a_long_text_leave_no_seam(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcd ") for _ in range(6000))
    whole = sorted((lo, hi, h, d) for _, lo, hi, h, d in suffix_dedup._contexts([text], 200))
    seen = set()
    monkeypatch.setattr(suffix_dedup, "PART_BITS", 10)
    for _, lo, hi, h, d in suffix_dedup._contexts([text], 200):
        seen.add((lo, hi, h, d))
    # Ties in fewer leading bits of a hash may move an anchor, but nearly all stay where they are.
    assert len(seen & set(whole)) > 0.9 * len(whole)


def test_rows_found_again_after_dedup_keep_clashing_columns(spark):
    docs = frame(spark, ["a", "b"]).withColumn("_key", F.lit(1))
    assert exact_dedup.dedup(docs).columns == docs.columns
