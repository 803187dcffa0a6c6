"""The registered queries over whole given tables against brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lodestone.llm import decontaminate, registry

SMALL, WHOLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {sf: {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()} for sf in (SMALL, WHOLE)}


def rows(spark, name, sf):
    return registry.QUERIES[name](spark, sf).collect()


def test_op1(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{WHOLE}/pages.parquet").collect()}
    first = {}
    for k in sorted(pages):
        first[pages[k]] = k
    got = rows(spark, "op1_warc_normaliser", WHOLE)
    assert len(got) == len(pages)
    for r in got:
        data = pages[r["page_id"]]
        again = first[data] != r["page_id"]
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want


def test_op4(spark, texts):
    got = rows(spark, "op4_hypergeometric_sharding", WHOLE)
    assert sorted(r["doc_id"] for r in got) == sorted(texts[WHOLE])
    slots = defaultdict(list)
    for r in got:
        data = texts[WHOLE][r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op5(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, "op5_weak_supervision", WHOLE)}
    assert set(got) == set(texts[WHOLE])
    for k, t in texts[WHOLE].items():
        words = WORD.findall(t)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(words), sum(map(len, words)), sum(map(t.count, "#*$%&|<>")), dup, len(inside), failed)
        assert not (failed and r["kept"])
    labels = spark.read.parquet(f"{WHOLE}/labels.parquet").collect()
    bad, good = ([got[x["doc_id"]]["kept"] for x in labels if x["quality"] == q and x["doc_id"] in got] for q in (0, 1))
    assert sum(bad) <= 0.02 * len(bad) and sum(good) >= 0.9 * len(good) and len(bad) > 20


def test_op6(spark, texts):
    seen, got = set(), {r["doc_id"]: r for r in rows(spark, "op6_repeated_substrings", SMALL)}
    for k in sorted(texts[SMALL]):
        data = texts[SMALL][k].encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            piece = data[i : i + 100]
            if piece in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())


def test_op7(spark, texts):
    sets = {}
    for k, t in texts[SMALL].items():
        words = WORD.findall(t)
        n = min(5, len(words))
        sets[k] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    group, links = {k: k for k in sets}, Counter()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = group[a], group[b]
                for k in ids:
                    if group[k] in (x, y):
                        group[k] = min(x, y)
    assert {r["doc_id"]: (r["group_id"], r["n_links"]) for r in rows(spark, "op7_ngram_jaccard_join", SMALL)} == {k: (group[k], links[k]) for k in ids}


def test_op8(spark):
    """Every page has its row; the text is made of the page's own blocks, in order, and nothing of menus and footers."""
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{WHOLE}/pages.parquet").collect()}
    got = rows(spark, "op8_mincut_extraction", WHOLE)
    assert sorted(r["page_id"] for r in got) == sorted(pages) and all(len(r["text"]) == r["n_chars"] for r in got)
    whole = sum("<article" in h for h in pages.values())
    assert sum(r["n_chars"] > 0 for r in got if "<article" in pages[r["page_id"]]) >= 0.95 * whole
    assert not any("©" in r["text"] or "track(" in r["text"] for r in got)


def test_op10(spark, texts):
    """Each item that a text holds word for word is found; texts without any piece of an item are left alone."""
    items = {r["item_id"]: decontaminate.words_of(r["text"] or "") for r in spark.read.parquet(f"{WHOLE}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in rows(spark, "op10_bm25_decontamination", WHOLE)}
    grams = {i: decontaminate.grams(w, 3) for i, w in items.items()}
    held = set()
    for k, t in texts[WHOLE].items():
        words = decontaminate.words_of(t)
        said, mine = f" {' '.join(words)} ", decontaminate.grams(words, 3)
        for i, w in items.items():
            if w and f" {' '.join(w)} " in said:
                held.add((k, i))
            assert (k, i) not in found or len(mine & grams[i]) >= 0.5 * len(grams[i])
    assert held <= found and held
