"""Token ids of whole texts, with a cache of short pieces.

A text is cut at places that no token crosses, so that ids of the pieces, joined, are the ids of the text.
Pieces repeat, and only new ones reach the tokenizer. The cache lives until other work calls :func:`release` in
the Python worker, or has another owner, and is emptied at ``CACHE_ENTRIES``, by halves for words.
"""

from __future__ import annotations

import re
import sys
import types
import unicodedata

import numpy as np

CACHE_ENTRIES = 400_000

#: Texts of these characters only are cut into the runs of the tokenizer's own pattern; others at white space.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡«»¿À-ÖØ-öø-ÿŒœ–—‘’“”…]*")
RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
SPACES = re.compile(r"[ \t\n\r]+")


def worker_state() -> types.SimpleNamespace:
    """State that outlives a task; the functions here are shipped by value and have no module of their own."""
    return sys.modules.setdefault("_threadloom_worker", types.SimpleNamespace(owner=None, caches={}, tokenizers={}))


def cache(name: str, owner: str) -> dict:
    """The pieces known to ``owner``; those of other owners are dropped, so a worker never holds two sets."""
    state = worker_state()
    if state.owner != owner:
        release()
        state.owner = owner
    found = state.caches.setdefault(name, {})
    if len(found) > CACHE_ENTRIES:
        found.clear()
    return found


def release() -> None:
    """Drop what an earlier stage has left in this worker; tasks that encode nothing call it."""
    state = worker_state()
    state.owner = None
    state.caches.clear()
    state.tokenizers.clear()


def word_tokenizer(path: str):
    tokenizers = worker_state().tokenizers
    if path not in tokenizers:
        from tokenizers import Tokenizer

        tokenizers[path] = Tokenizer.from_file(path)
    return tokenizers[path]


def word_ids(texts, path: str):
    """Yield the ids of each text as little-endian unsigned 32-bit bytes, as ``Tokenizer.encode`` gives them.

    Words and runs are known in two halves: when the newer one is full it becomes the older, so that words still in
    use are carried over and only those not seen for a while are encoded again.
    """
    known = cache("words", path)
    older = worker_state().caches.setdefault("older words", {})
    for text in texts:
        plain = PLAIN.fullmatch(text) and "<|" not in text and unicodedata.is_normalized("NFC", text)
        # a plain text has no other white space; in one case a word is known once
        words = text.lower().split() if plain else SPACES.split(text)
        missing = set(words).difference(known)
        if missing and len(known) >= CACHE_ENTRIES:
            known, older = next_half(known)
            missing = set(words)
        if missing and older:
            kept = {w: older[w] for w in missing if w in older}
            known.update(kept)
            missing.difference_update(kept)
        if missing and plain:
            pieces = [[w] if w.isalpha() else RUN.findall(w) for w in missing]
            runs = {p for found in pieces for p in found}.difference(known)
            kept = {p: older[p] for p in runs if p in older}
            known.update(kept)
            new = list(runs.difference(kept))
            known.update(zip(new, run_ids(new, path)))
            for word, found in zip(missing, pieces):
                if len(found) != 1:  # a word of one run is that run
                    known[word] = b"".join(map(known.__getitem__, found))
        elif missing:
            missing = list(missing)
            for word, found in zip(missing, word_tokenizer(path).encode_batch(missing, add_special_tokens=False)):
                known[word] = np.array(found.ids, "<u4").tobytes()
        yield b"".join(map(known.__getitem__, words))


def next_half(known: dict) -> tuple[dict, dict]:
    """An empty set of known words, and the full one as the older half."""
    caches = worker_state().caches
    caches["words"], caches["older words"] = {}, known
    return caches["words"], known


def run_ids(runs: list[str], path: str):
    """Ids of runs that are one word each: encoded as one text, cut at the word ends."""
    if not runs:
        return
    ids = np.array(word_tokenizer(path).encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
    stops = np.flatnonzero(word_ends(path)[ids]) + 1
    assert len(stops) == len(runs)
    start, raw = 0, ids.tobytes()
    for stop in stops.tolist():
        yield raw[4 * start : 4 * stop]
        start = stop


def word_ends(path: str) -> np.ndarray:
    """For each id, whether its token ends a word."""
    kept = worker_state().tokenizers
    if (path, "ends") not in kept:
        vocabulary = word_tokenizer(path).get_vocab()
        flags = np.zeros(max(vocabulary.values()) + 1, bool)
        flags[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        kept[path, "ends"] = flags
    return kept[path, "ends"]


def rank_counts(texts, path: str, pattern: str):
    """Number of tokens of each text under a rank file of a byte-level vocabulary."""
    kept = worker_state().tokenizers
    if path not in kept:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        kept[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encode = kept[path].encode_ordinary
    return [len(encode(text)) for text in texts]


class PieceModel:
    """A byte-fallback vocabulary, read word by word."""

    def __init__(self, path: str):
        self.known = cache("words", path)
        kept = worker_state().tokenizers
        if path not in kept:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            kept[path] = model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        self.model, self.is_byte = kept[path]

    def ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        missing = [w for w in set(words) if w not in known]
        if missing:
            if len(known) > CACHE_ENTRIES:
                known.clear()
                missing = list(set(words))
            for word, ids in zip(missing, self.model.encode(missing, num_threads=1)):
                known[word] = np.array(ids, "<u2").tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u2")
