"""Spelling variants, tokenizer alignment and sharding against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpus_fixtures import SF_DIR, docs_of, empty, odd, odd_documents, table  # noqa: F401
from pyspark.sql import functions as F

from rolltally.llm import alignment, queries, sharding, variants

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- spelling variants -------------------------------------------------------------------


def plain_words(rows, spoil=None, least=6):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if spoil:
                h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % spoil == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit_away(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts):
    near = {w: [v for v in counts if v != w and one_edit_away(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def test_variants_of_the_whole_table(spark, table):
    rows = [tuple(r) for r in table("documents").select("doc_id", "text").collect()]
    found = {tuple(r) for r in queries.op11_spelling_variants(spark, SF_DIR).collect()}
    assert found == plain_variants(plain_words(rows, spoil=199))


def test_variants_of_words_full_of_repeated_letters(spark):
    rng = random.Random(5)
    counts = {}
    for k in range(400):
        word = "".join(rng.choice("aabé") for _ in range(rng.randint(5, 8)))
        counts[word] = rng.choice([5, 5, 6, 30, 150, 800, 5000, 30000])
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    found = {tuple(r) for r in variants.spelling_variants(spark, words).collect()}
    expected = plain_variants(counts)
    assert found == expected
    # Chains of several forms occur, and ties.
    assert max(len([1 for _ in iter_chain(expected, w)]) for w in counts) >= 3


def iter_chain(rows, word):
    form = {r[0]: r[1] for r in rows}
    while word is not None:
        yield word
        word = form[word]


def test_words_of_odd_tables(spark, docs_of, odd, empty):
    assert variants.variants_of(spark, empty).count() == 0
    rows = [(r[0], r[1]) for r in odd_documents()]
    found = {tuple(r) for r in variants.variants_of(spark, odd, spoil_one_in=3).collect()}
    assert found == plain_variants(plain_words(rows, spoil=3))


# --- tokenizer alignment -----------------------------------------------------------------


def plain_alignment(rows):
    """Whole texts through the libraries, offsets as sets, all links listed."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = alignment.byte_level_alphabet()
    docs, holders = [], defaultdict(set)
    for k, (doc_id, text) in enumerate(rows):
        a = first.encode(" " + text, add_special_tokens=False) if text else None
        b = second.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a.ids] if text else []
        bytes_b = [bytes([second.id_to_piece(i).encode()[3:5] and int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append((doc_id, [], [], [], []))
            continue
        spans = []
        for pieces in (bytes_a, bytes_b):
            ends = np.cumsum([len(p) for p in pieces])
            spans.append(list(zip((ends - [len(p) for p in pieces]).tolist(), ends.tolist())))
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in common:
            groups.append(([i for i, (s, e) in zip(a.ids, spans[0]) if low < e <= cut], [i for i, (s, e) in zip(b, spans[1]) if low < e <= cut]))
            low = cut
        links, j = [], 0
        for i, (s, e) in zip(a.ids, spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k2 = j
            while k2 < len(b) and spans[1][k2][0] < e:
                links.append((i, b[k2]))
                k2 += 1
        for pair in links:
            holders[pair].add(k)
        docs.append((doc_id, a.ids, b, groups, links))
    highest = Counter()
    for (i, _), held in holders.items():
        highest[i] = max(highest[i], len(held))
    out = []
    for doc_id, a, b, groups, links in docs:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        counts = [len(holders[p]) for p in links]
        digest = sha256(written.encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), digest, sum(n == highest[p[0]] for n, p in zip(counts, links)), sum(counts)))
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def odd_texts():
    spaces = [" ", "  ", "\n", "\t ", " \n ", "\x0b", "\x1c", "\x1f", "\x85", " ", " ", " ", " ", " ", "　", "​", "﻿", "\x00"]
    rng = random.Random(3)
    some = ["word", "don't", "I'll", "'s", "12", "345", "é", "漢字", "ǅ", "!?", "<|endoftext|>", "<s>", "</s>", "<0x41>", "👩‍👩‍👧", "x" * 50, "_", "Ünï", "́a", "²", "Ⅷ"]
    texts = [f"{x}{gap}{y}" for gap in spaces for x in ("a", "!", "1") for y in ("b", "?", "2")]
    texts += ["".join(rng.choice(some) + rng.choice(spaces) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return [*texts, " ", "  ", " a", "a ", "▁", "a▁b c", "\n", "plain words only"]


def test_alignment_of_the_whole_table(spark, table):
    rows = [tuple(r) for r in table("documents").select("doc_id", "text").collect()]
    found = queries.op12_tokenizer_alignment(spark, SF_DIR).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert in_order(found.collect()) == in_order(plain_alignment(rows))


def test_alignment_of_odd_texts(spark, docs_of, odd, empty, monkeypatch):
    rows = [(k, t, "en", "s", None) for k, t in enumerate(odd_texts())]
    found = alignment.align(spark, docs_of(rows).repartition(3), A, B)
    assert in_order(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()) == in_order(plain_alignment([r[:2] for r in rows]))
    assert alignment.align(spark, empty, A, B).count() == 0
    found = alignment.align(spark, odd, A, B).drop("n_best", "count_sum")
    expected = [r[:6] for r in plain_alignment([r[:2] for r in odd_documents() if len(r[1] or "") < 100_000])]
    have = [r for r in found.collect() if r["n_a"] < 30_000]
    assert len(have) + 2 == len(odd_documents())
    assert in_order(x for x in have if x["n_a"]) == in_order(x for x in expected if x[1])


def test_parts_give_the_ids_of_whole_texts():
    encoders = alignment.Encoders(A, B)
    assert encoders.by_parts
    texts = odd_texts()
    for limit in (0, 10**9):
        ids_a, n_a, ids_b, n_b = encoders.encode(texts)
        encoders.by_parts = False
        whole = encoders.encode(texts)
        encoders.by_parts = True
        for one, other in zip((ids_a, n_a, ids_b, n_b), whole):
            assert np.array_equal(one, other)
        encoders.forget()


def test_new_parts_are_encoded_many_in_one_call(monkeypatch):
    encoders, given = alignment.Encoders(A, B), []
    encode = encoders.a.encode
    monkeypatch.setattr(encoders.a, "encode", lambda texts: given.extend(texts) or encode(texts))
    parts = [f"part{k}" for k in range(3000)] + ["\x00", "\u2581", "\u00e9\u6f22", "<|endoftext|>", "it's", "\tx", "y\n\n", " ", "a  b"]
    texts = [" ".join(parts), "\u2581 one", None, ""]
    found = encoders.encode(texts)
    assert len(given) < 1000
    monkeypatch.setattr(alignment, "STRING_CHARS", 1)
    apart = alignment.Encoders(A, B)
    for x, y in zip(found, apart.encode(texts)):
        assert x.tolist() == y.tolist()
    # Parts whose bytes do not come back leave those strung with them as they are.
    texts = ["one two \u2581 three", "one two three"]
    a, n_a, b, n_b = encoders.encode(texts)
    assert n_a.tolist()[0] == n_b.tolist()[0] == 0 and a.tolist() == encode(texts[1:])[0] and b.tolist() == encoders.b.encode(texts[1:])[0]


def test_cuts_by_halving_are_all_common_ends():
    rng = np.random.default_rng(7)
    for _ in range(200):
        counts, ends_a, ends_b, base = [], [], [], 0
        for _ in range(rng.integers(1, 5)):
            size = int(rng.integers(1, 300))
            a = np.unique(np.append(rng.integers(1, size + 1, rng.integers(1, 60)), size))
            b = np.unique(np.append(rng.integers(1, size + 1, rng.integers(1, 60)), size))
            counts.append(len(a))
            ends_a.append(a + base)
            ends_b.append(b + base)
            base += size
        a, b = np.concatenate(ends_a), np.concatenate(ends_b)
        at_a, at_b = alignment.common_cuts(a, b, np.array(counts))
        assert a[at_a].tolist() == np.intersect1d(a, b).tolist() == b[at_b].tolist()


def test_holds_take_three_bytes_for_a_document_and_pair():
    rng = np.random.default_rng(1)
    for n_pairs, width in ((5000, 3), (70_000, 5)):
        key = rng.permutation(np.unique(rng.integers(0, 6 * n_pairs, 4000)))
        held_by, held = key // n_pairs, key % n_pairs
        for times in (rng.integers(1, 256, len(key)), rng.choice([1, 255, 256, 510, 511, 100_000], len(key))):
            values = rng.integers(0, 1 << 40, n_pairs), rng.integers(0, 2, n_pairs)
            packed = alignment.packed_holds(held_by, held, times, 8, n_pairs)
            for value, found in zip(values, alignment.sums_of_holds(*packed, *values)):
                expected = np.zeros(8, dtype=np.int64)
                np.add.at(expected, held_by, times * value[held])
                assert found.tolist() == expected.tolist()
            if times.max() <= 255:
                assert sum(map(len, packed)) == width * len(key) + 4 * 8
    none = np.zeros(0, dtype=np.int64)
    assert alignment.sums_of_holds(*alignment.packed_holds(none, none, none, 2, 0), none)[0].tolist() == [0, 0]


def test_texts_without_characters_fill_chunks():
    batch = pa.RecordBatch.from_arrays([pa.array(range(100_000), pa.int64()), pa.array([None, ""] * 50_000, pa.string())], names=["doc_id", "text"])
    sizes = [len(ids) for ids, _ in alignment._chunks([batch])]
    assert sum(sizes) == 100_000 and max(sizes) < 20_000


def test_alignment_hands_workers_few_rows_at_once(spark, docs_of, monkeypatch):
    def rows_in_batches(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, most, handover = spark.conf.get(key), {}, alignment.handover

    def watched(spark, df, label):
        read = spark.range(2000, numPartitions=1).mapInArrow(rows_in_batches, "n long").collect()
        most[label] = max(r["n"] for r in read)
        return handover(spark, df, label)

    monkeypatch.setattr(alignment, "handover", watched)
    rows = [(k, "one text" if k % 3 else None, "en", "s", None) for k in range(600)]
    found = alignment.align(spark, docs_of(rows), A, B).collect()
    assert len(found) == 600 and {r["count_sum"] for r in found if not r["n_a"]} == {0}
    assert most["alignment-chunks"] <= 256 and most["alignment-totals"] <= 16
    assert spark.conf.get(key) == before


def test_aligned_tokens_hold_the_groups(spark, table):
    docs = table("documents").where("doc_id < 5")
    for row in alignment.aligned_tokens(docs, A, B).collect():
        assert row["a_ends"][-1] == len(row["a"]) and row["b_ends"][-1] == len(row["b"])
        assert len(row["a_ends"]) == len(row["b_ends"]) and row["a_ends"] == sorted(set(row["a_ends"]))


# --- sharding ----------------------------------------------------------------------------


def check_law(rows, shards=16):
    """Counts at most one apart, slots without gaps; ``rows`` are (key, shard, slot)."""
    slots = defaultdict(list)
    for _, shard, slot in rows:
        slots[shard].append(slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def shards_of_groups(rows):
    found = defaultdict(set)
    for key, shard, _ in rows:
        found[key].add(shard)
    return found


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_shards_of_documents(spark, sf):
    path = f"/root/testdata/sf{sf}"
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op13_sharding(spark, path).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, crc32(data), "rows", None)
    triples = [(docs[r["doc_id"]] or "", r["shard"], r["slot"]) for r in rows]
    check_law(triples)
    # Every group of copies fits into a shard here, and is in one.
    sizes = Counter(t for t, _, _ in triples)
    split = [t for t, s in shards_of_groups(triples).items() if len(s) > 1]
    assert sum(sizes[t] for t in split) <= 0.02 * sum(n for n in sizes.values() if n > 1)


def test_shards_with_a_group_of_a_third_and_groups_only(spark, docs_of):
    rows = [(i, "the same text", "en", "s", 1) for i in range(1000)] + [(1000 + i, f"text {i // 5}", "en", "s", 1) for i in range(2003)]
    dealt = sharding.balanced_shards(spark, docs_of(rows).repartition(5)).select("row.doc_id", "shard", "slot").collect()
    text = {r[0]: r[1] for r in rows}
    triples = [(text[r[0]], r[1], r[2]) for r in dealt]
    check_law(triples)
    found = shards_of_groups(triples)
    # Nothing is without companions to fill up with, so some groups are cut where shards end.
    held = Counter(shard for t, shard, _ in triples if t == "the same text")
    assert max(held.values()) > 2 * 1000 / 16
    assert sum(len(s) == 1 for t, s in found.items() if t != "the same text") > 0.7 * 400


def test_turns_only_bring_groups_together(spark, docs_of):
    rows = [(i, f"text {i % 700}", "en", "s", 1) for i in range(2100)] + [(5000 + i, f"alone {i}", "en", "s", 1) for i in range(2000)]
    text = {r[0]: r[1] for r in rows}
    cut = []
    for turns in (0, 1, 12):
        dealt = sharding.balanced_shards(spark, docs_of(rows).repartition(4), most_turns=turns).select("row.doc_id", "shard", "slot").collect()
        triples = [(text[r[0]], r[1], r[2]) for r in dealt]
        check_law(triples)
        cut.append(sum(len(s) - 1 for s in shards_of_groups(triples).values()))
    assert cut[0] > 1000 and cut[1] < cut[0] / 4 and cut[2] <= 3


def test_shards_of_odd_tables(spark, odd, empty):
    assert sharding.balanced_shards(spark, empty).count() == 0
    dealt = sharding.balanced_shards(spark, odd, shards=3).select("row.doc_id", "size", "shard", "slot").collect()
    assert len(dealt) == len(odd_documents())
    check_law([(r[0], r[2], r[3]) for r in dealt], 3)
    assert sorted(r[1] for r in dealt) == sorted(len((r[1] or "").encode()) + 1 for r in odd_documents())
    by_source = sharding.balanced_shards(spark, odd, shards=2, group=F.col("source"), keep=("doc_id", "a.b"))
    check_law([tuple(r) for r in by_source.select("row.doc_id", "shard", "slot").collect()], 2)
    with pytest.raises(ValueError):
        sharding.balanced_shards(spark, odd, shards=0)
