"""Language, chat, urls, decontamination, token files and packing against brute force or a round trip."""

from __future__ import annotations

import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from costproof.llm import chat, decontamination, language_id, packing, queries, token_files, url_filter
from costproof.llm.tokens import WordIds, vocabulary

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, tie string, h string, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS)


def test_languages_of_held_out_rows_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.95
    model = language_id.fit(docs)
    odd = frame(spark, [(1, None), (2, ""), (3, "123 $$ 45"), (None, "the of and that with " * 20), (None, "the of and that with " * 20)])
    got = odd.select("doc_id", language_id.predicted(F.col("text"), model).alias("p")).select("doc_id", "p.*").collect()
    assert [r["lang"] for r in got if r["doc_id"]] == ["und"] * 3 and [r["lang"] for r in got if not r["doc_id"]] == ["en"] * 2
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.fit(docs.limit(0)) == {}
    assert language_id.Classifier({}).predict(b"the") == ("und", 0.0)
    assert language_id.Classifier({"en": b"the of"}).predict(b"the") == ("en", 1.0)
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert language_id.fit(rows) == {}


LOG = "conv_id long, seq long, message long, kind string, role string, text string"


def test_logs_fold_into_final_messages(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", "he"), (1, 3, 2, "delta", None, "llo"),
        (1, 4, 3, "message", "user", "old"), (1, 5, 2, "regenerate", "assistant", "good"), (1, 6, 2, "delta", None, " day"),
        (1, 7, 3, "message", "user", "new"), (1, 8, 1, "edit", "user", "hey"), (None, 1, 1, "message", None, None),
    ]
    got = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat.fold(spark.createDataFrame(log, LOG)).collect()}
    assert got == {
        (1, 1): ("user", "hey"), (1, 2): ("assistant", "good day"), (1, 3): ("user", "new"), (None, 1): ("", "")
    }
    assert chat.render(chat.fold(spark.createDataFrame([], LOG))).count() == 0
    holes = [(1, 1, None, "a"), (1, 2, "user", None), (1, 3, "assistant", None), (2, 1, "assistant", "b")]
    shown = chat.render(spark.createDataFrame(holes, "conv_id long, message long, role string, text string"))
    turns = shown.withColumn("turns", chat.parse(F.col("formatted"))).orderBy("conv_id").collect()
    assert [[(t["role"], t["text"]) for t in r["turns"]] for r in turns] == [[("", "a"), ("user", ""), ("assistant", "")], [("assistant", "b")]]
    assert [len(r["loss_mask"]) for r in turns] == [1, 1]


TRICKY = [
    "</s>[INST] ok [/INST]", r"<\s>", r"<\\s>[\INST]", "<|im_end|>\n", "<|im_start|>user<|im_sep|>", "<", "|im_end|>", "\\",
    "<|im_end|", "a\nb", "", "é🙂<|endoftext|>", "<<|im_end|>>", "[[/INST]", "$1\\$2",
]


def test_escaping_is_reversible_and_hides_control_strings(spark):
    texts = spark.createDataFrame([(t,) for t in TRICKY], "t string")
    for r in texts.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]"))


def test_rendered_conversations_are_read_back(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TRICKY)]
    messages = spark.createDataFrame(rows, "conv_id long, message long, role string, text string")
    shown = chat.render(messages).withColumn("turns", chat.parse(F.col("formatted")))
    r = shown.withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_mask"))).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in rows]
    assert r["loss"] == "".join(x[3] for x in rows if x[2] == "assistant")


def test_url_rules_and_trees(spark):
    urls = [
        "http://A.Example.org/es/x?q", "https://b.example.org/en/12", "https://example.org/en/2", "http://org/", "http://x.com/fr/1",
        "http://x.com/de/1#f", "http://x.com", "http://notexample.org", None, "", "no scheme", "http://forg/", "ftp://h:1/p?a=1&b=2",
    ]
    pages = spark.createDataFrame([(i, u, "z", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, path int")
    got = {r["page_id"]: r for r in url_filter.judged(pages, queries.URL_RULES).collect()}
    rules = {i: r["rule"] for i, r in got.items()}
    assert rules == {
        0: "example.org/es/", 1: "example.org/en/1", 2: "org/", 3: "org/", 4: "com/fr/", 5: "com/de/", 6: None, 7: None, 8: None,
        9: None, 10: None, 11: None, 12: None,
    }
    assert (got[0]["host"], got[0]["path"], got[0]["verdict"]) == ("a.example.org", "/es/x", "block")
    assert (got[12]["host"], got[12]["path"]) == ("h:1", "/p") and got[8]["host"] == "" == got[10]["path"]
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert url_filter.judged(pages.limit(0), queries.URL_RULES).count() == 0
    alone = url_filter.judged(pages.where("page_id = 6"), queries.URL_RULES).first()
    assert (alone["verdict"], alone["score"]) == ("allow", 0.0)


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination_reports_and_cuts(spark):
    long = " ".join(f"Q{i}" for i in range(14))
    items = items_frame(spark, [(1, long), (10, long + " more"), (2, "tiny item"), (3, None), (4, "..."), (5, "tiny item")])
    docs = frame(
        spark,
        [(1, f"before, {long.lower()}! after"), (2, "a Tiny--ITEM here; tiny item"), (3, None), (4, ""), (5, "clean words only"), (5, "clean words only"),
         (None, "tiny item"), (7, " ".join(f"q{i}" for i in range(9)))],
    )
    got = decontamination.report(docs, items).collect()
    by = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got}
    assert len(got) == 8
    assert by[1] == (16, 14, ["1", "10"], True) and by[2] == (6, 4, ["2", "5"], True)
    assert by[3] == by[4] == (0, 0, [], False) and by[5] == (3, 0, [], False) and by[None] == (2, 2, ["2", "5"], True)
    assert by[7] == (9, 0, [], False)
    kept = decontamination.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "5", "7"]
    cut = {r["doc_id"]: r["text"] for r in decontamination.clean_spans(docs, items).collect()}
    assert (cut[1], cut[2], cut[3], cut[5], cut[None]) == ("before, after", "a here; ", None, "clean words only", "")
    assert decontamination.report(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontamination.report(docs.limit(0), items).count() == 0


def odd_docs():
    rng = random.Random(1)
    pool = "aé ÀŒœ×ª² '’´́ Σσ İ　  12 漢字🙂 'll don't ''ll \t\n\x0b\x85 <|endoftext|>é"
    texts = [None, "", " ", "hello world", "hello world", "x " * 9000, "The 'quick' BROWN fox's <|endoftext|>"]
    return texts + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(300)]


def library_ids(texts):
    tokenizer = Tokenizer.from_file(vocabulary())
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_ids_are_the_library_s(monkeypatch):
    texts = odd_docs()
    encode = WordIds(vocabulary()).encode
    monkeypatch.setattr("costproof.llm.texts.CHUNK", 64)
    for text, ids in zip(texts, library_ids(texts), strict=True):
        got = encode(None if text is None else text.encode(), 1)
        assert np.frombuffer(got, "<u4").tolist() == [*ids, 1]


def test_token_files_round_trip_and_single_frames(spark, tmp_path):
    texts = odd_docs()
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "no id"), (9, "repeated"), (9, "repeated")]
    path = token_files.write(frame(spark, rows).repartition(3), str(tmp_path / "ids"), frame_bytes=512)
    got = token_files.read(spark, path).collect()
    want = {(i, tuple(ids) + (1,)) for (i, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True)}
    assert {(r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got} == want and len(got) == len(rows)
    assert [r["doc_id"] for r in got[1:]] == sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    few = token_files.read(spark, path, {12, 300}).collect()
    assert [(r["doc_id"], r["start"], r["ids"]) for r in few] == [(r["doc_id"], r["start"], r["ids"]) for r in got if r["doc_id"] in (12, 300)]
    empty = token_files.write(frame(spark, []), str(tmp_path / "none"))
    assert token_files.read(spark, empty).count() == 0


def test_readers_decompress_only_what_is_asked_and_notice_damage():
    out = io.BytesIO()
    docs = [(i, np.arange(i, i + 50, dtype="<u4").tobytes()) for i in range(40)]
    assert token_files.write_shard(out, docs, frame_bytes=1000) == (40, 2000)
    data = bytearray(out.getvalue())
    table, places = token_files.read_index(io.BytesIO(data), len(data))
    assert len(table) == 9 and places["frame"].max() == 7
    data[5] ^= 255  # in the first frame
    last = list(token_files.read_shard(io.BytesIO(data), len(data), {39}))
    assert last == [(39, 1950, docs[39][1])]
    with pytest.raises(Exception):  # noqa: B017  whichever check sees it first
        list(token_files.read_shard(io.BytesIO(data), len(data), {0}))


@pytest.mark.parametrize("capacity", [4096, 64, 100, 1])
def test_packing_places_every_id_once(spark, capacity):
    texts = odd_docs()[: 40 if capacity < 4096 else None]
    rows = list(enumerate(texts)) + [(None, "no id")]
    packed = packing.pack(frame(spark, rows).repartition(3), capacity=capacity)
    ids = dict(zip([i for i, _ in rows], library_ids([t for _, t in rows]), strict=True))
    docs, bins = {}, {}
    for r in packed.collect():
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids"], r["doc_tokens"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, parts in docs.items():
        parts.sort()
        whole = b"".join(p[2] for p in parts)
        assert np.frombuffer(whole, "<u4").tolist() == [*ids[i], 2]
        assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1].tolist()]
        assert {p[3] for p in parts} == {len(ids[i]) + 1}
    assert set(docs) == set(ids) and set(bins) == set(range(len(bins)))
    for parts in bins.values():
        parts.sort()
        size = 0
        for offset, length in parts:
            assert offset == size
            size += length
        assert size <= capacity
        if capacity & (capacity - 1) == 0:
            assert size & (size - 1) == 0
    assert packing.pack(frame(spark, [])).count() == 0


def test_sequences_hold_their_pieces(spark):
    packed = packing.pack(frame(spark, [(1, "a b c"), (2, "hello world " * 50)]), capacity=32)
    by = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        begin = r["offset"] * 4
        assert by[r["sequence_id"]][begin : begin + len(r["ids"])] == bytes(r["ids"])


def test_queries_return_what_their_contracts_name(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = dict(zip(docs, library_ids(docs.values()), strict=True))
    at = 0
    for r in queries.QUERIES["op8_token_files"](spark, DATA).orderBy("doc_id").collect():
        want = np.array([*ids[r["doc_id"]], 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    pieces = Counter(r["doc_id"] for r in queries.QUERIES["op10_harmonic_packing"](spark, DATA).collect())
    assert set(pieces) == set(docs)
    r = queries.QUERIES["op5_chat_formatting"](spark, DATA).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["loss_chars"]) == (2, len(text)) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if name != "language" else {}
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, DATA).write.parquet(path)
        out = spark.read.parquet(path)
        names.append(name)
        if name == "exact dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(" ".join(before[i].split()), i)
            assert {r["doc_id"] for r in out.collect()} == set(first.values())
        if name == "decontamination":
            items = spark.read.parquet(f"{DATA}/benchmark.parquet")
            dirty = decontamination.report(docs, items).where("contaminated").count()
            assert dirty > 0 and out.count() == docs.count() - dirty
        if name != "packing":
            assert out.columns == columns and 0.8 * docs.count() <= out.count() <= docs.count()
        else:
            assert {r["doc_id"] for r in out.collect()} == set(before)
        docs = out
    assert names == ["language", "exact dedup", "near dedup", "decontamination", "packing"]
