import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import CLASHES, corpus, documents, prose
from tokenizers import Tokenizer

from threadloom.llm import decontaminate, encode, packing, quality_rules, token_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(rows, items):
    windows = {}
    for item, text in items:
        w = lower_words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for row in rows:
        w, hit, found = lower_words(row[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((row[0], len(w), len(hit), tuple(sorted(map(str, found))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_contamination_equals_brute_force(spark, most):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(14, 40))) for i in range(5)] + [(7, "Three Little words"), (8, ""), (9, None), (10, "Three little words")]
    rows = corpus()
    for i, (_, text) in enumerate(items[:5]):
        rows.append((3000 + i, f"{prose(rng, 40)} {text.upper()}, {prose(rng, 10 + 300 * (i % 2))} three LITTLE-words", "en", "s", 0))
    docs, benchmark = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    done = decontaminate.flagged(docs, benchmark, broadcast_windows=most)
    got = [
        (r.doc_id, c.n_words, c.n_hit, tuple(sorted(map(str, c["items"]))), c.contaminated)
        for r in done.collect()
        for c in [r.contamination]
    ]
    assert sorted(map(repr, got)) == brute_contamination(rows, items)
    clean = decontaminate.cleaned(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not g[-1] for g in got)
    assert all(r[c] == f"own {c}" for r in clean.collect() for c in CLASHES)
    cut = decontaminate.cleaned(docs, benchmark, remove="spans").filter("doc_id >= 3000")
    assert all("three little words" not in r.text for r in cut.collect())
    nothing = decontaminate.flagged(docs, benchmark.limit(0)).filter("contamination.contaminated")
    assert nothing.count() == 0 and decontaminate.flagged(docs.limit(0), benchmark).count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_quality_base_equals_brute_force(spark):
    rows = corpus() + [(5000, "a b c\na b c\n\n \na b c # % <x>\n" * 30, "en", "s", 0), (5001, "\x1ca\x0bb c", "en", "s", 0)]
    docs = documents(spark, rows)
    done = quality_rules.judged(docs, public_tokenizers.path("piece_bpe_32k.model"), least=5)
    got, want = [], []
    for r in done.collect():
        q = r.quality
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)
        assert not (q.base_failed and q.kept)
        got.append((r.doc_id, q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words))
    for row in rows:
        want.append((row[0], *brute_quality(row[1])))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = quality_rules.kept(docs, public_tokenizers.path("piece_bpe_32k.model"), least=5)
    assert kept.columns == docs.columns and all(r[c] == f"own {c}" for r in kept.collect() for c in CLASHES)
    assert quality_rules.kept(documents(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_quality_rejects_noise_in_its_language(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 120), "en", "s", 0) for i in range(60)]
    noise = " ".join("".join(chr(rng.randint(0x2400, 0x2426)) for _ in range(5)) for _ in range(80))
    rows += [(100, noise, "en", "s", 0), (101, noise + "x", None, "s", 0)]
    done = quality_rules.judged(documents(spark, rows), public_tokenizers.path("piece_bpe_32k.model"), least=20)
    verdict = {r.doc_id: r.quality.kept for r in done.collect()}
    assert not verdict[100] and not verdict[101] and all(verdict[i] for i in range(60))


def test_quality_keeps_clean_documents_of_rare_scripts(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, 80), "en", "s", 0) for i in range(400)]
    for lang, first, n in (("el", 0x3B1, 60), ("zh", 0x4E00, 60), (None, 0x430, 12)):
        for _ in range(n):
            text = " ".join("".join(chr(first + rng.randrange(24)) for _ in range(rng.randint(2, 8))) for _ in range(80))
            rows.append((len(rows), text, lang, "s", 0))
    done = quality_rules.judged(documents(spark, rows), public_tokenizers.path("piece_bpe_32k.model"))
    verdict = Counter((r.lang, r.quality.kept) for r in done.collect())
    assert verdict["el", True] == verdict["zh", True] == 60 and verdict[None, True] == 12


def test_packing_equals_the_tokenizer(spark):
    rng = random.Random(11)
    rows = corpus() + [
        (4000, prose(rng, 3000), "en", "s", 0),
        (4001, "It's <|endoftext|> naïve ½ Ａ 漢字 İ ΣΑΣ é we'll\x1cx", None, "s", 0),
        (4002, "a b İ ''s 'S 12ab_c-d <|x", None, "s", 0),
    ]
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.packed(documents(spark, rows), path, with_ids=True).collect()
    want = []
    for row in rows:
        ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 1]
        start = 0
        for length in packing.decompose(len(ids)):
            part = ids[start : start + length]
            want.append((row[0], start, length, zlib.crc32(np.array(part, "<u4").tobytes()), len(ids), part))
            start += length
        assert start == len(ids)
    assert sorted(repr((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.ids)) for r in got) == sorted(map(repr, want))
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    assert all(r.length & r.length - 1 == 0 and r.length <= 2048 for r in got)
    assert packing.packed(documents(spark, []), path).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(documents(spark, []), path, longest=100)


def test_token_counts_equal_sums(spark):
    import tiktoken, base64

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus()
    lengths = [len(encoding.encode_ordinary(r[1] or "")) for r in rows]
    hist = token_counts.histogram(documents(spark, rows), path, public_tokenizers.PATTERN)
    table = token_counts.limits(hist).cache()
    got = {r.context_limit: r for r in table.collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r.n_docs == lengths.count(limit) and r.n_docs_from == sum(n >= limit for n in lengths)
        assert r.tokens_from == sum(n for n in lengths if n >= limit)
        assert r.tokens_truncated == sum(min(n, limit) for n in lengths)
        assert r.quantile == sum(n <= limit for n in lengths) / len(lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    for limit in (0, 1, 77, 10**6):
        assert token_counts.truncated_total(table, limit).first().tokens == sum(min(n, limit) for n in lengths)
    shares = {r.share: r.n_tokens for r in token_counts.quantiles(table, [0.5, 1.0]).collect()}
    assert shares[1.0] == max(lengths) and shares[0.5] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    none = token_counts.limits(token_counts.histogram(documents(spark, []), path, public_tokenizers.PATTERN))
    assert none.count() == 0 and token_counts.truncated_total(none, 5).first().tokens == 0


def test_words_in_use_stay_known_when_the_cache_is_full(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, asked, run_ids = encode.word_tokenizer(path), [], encode.run_ids

    def counted(runs, path):
        asked.extend(runs)
        return run_ids(runs, path)

    monkeypatch.setattr(encode, "CACHE_ENTRIES", 40)
    monkeypatch.setattr(encode, "run_ids", counted)
    encode.release()
    texts = [f"The\tcommon words, don't 'stop (ever): été «ici» zq{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts += ["a\x0bb \x85 c\xa0d", "Ünï – THE the The", "漢字 the common", "<|x|> The", ""]
    for text, ids in zip(texts, encode.word_ids(texts, path)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert asked.count("common") == asked.count("the") == 1
    encode.release()
