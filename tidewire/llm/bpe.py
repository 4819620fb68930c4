"""Exact BPE encoding without a merge loop, and decoding by a table of offsets.

A word is a string of symbols: its bytes, the last one marked as an ending where the vocabulary has word ends.
An Aho-Corasick automaton over the reversed tokens reads the reversed word once and tells, for every position, the
longest token that begins there. The encoder takes the longest one, checks it against its left neighbour and goes
on; where no shorter prefix fits either, it steps back over the last token and marks the position as a dead end,
so every position is given up once at most and the time is linear. A pair of neighbours fits if merging the two
strings would never join anything across their border; whether it does is looked up in a table of pairs that fills
as pairs appear (bounded, by the tokens alone when it starts anew). A sequence whose neighbours all fit is what the
merges, applied by rank, arrive at.

Normalising and cutting into words are the tokenizer's own first steps; each distinct word is encoded once. Decoding reads each token's bytes from one buffer between two offsets.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.hashing import byte_slices
from tidewire.llm.token_counts import pre_tokens
from tidewire.storage import table


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens as strings of symbols, numbered by rank: the symbols first, then one token for each merge.

    A symbol is one character: a byte, or 256 + a byte that ends a word. ``left`` and ``right`` are a token's parts
    (itself, for a symbol), ``ids`` the file's numbers, ``pair`` the token that two tokens merge to.
    """

    def __init__(self, spec: dict):
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain byte-level BPE")
        self.end, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]

        def symbols(token: str) -> str:
            ends = self.end and token.endswith(self.end)
            s = "".join(chr(letters[c]) for c in (token[: -len(self.end)] if ends else token))
            return s[:-1] + chr(256 + ord(s[-1])) if ends else s

        base = sorted((t for t in vocab if len(t.removesuffix(self.end) if self.end else t) == 1 and all(c in letters for c in (t.removesuffix(self.end) if self.end else t))), key=vocab.get)
        number = {t: i for i, t in enumerate([*base, *(a + b for a, b in merges)])}
        if len(number) != len(base) + len(merges):
            raise ValueError("a token that two merges make has no one rank")
        self.text = [symbols(t) for t in number]
        self.ids = np.array([vocab[t] for t in number], np.int32)
        self.left, self.right = list(range(len(base))), list(range(len(base)))
        self.pair: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges, len(base)):
            self.left.append(number[a])
            self.right.append(number[b])
            self.pair[number[a], number[b]] = rank
        self.base = len(base)

    def fits(self, one: int, two: int, limit: int | None = None) -> bool:
        """Whether merging the symbols of ``one`` and ``two`` by rank (below ``limit``) leaves both as they are.

        The border is followed back in time: the part made last is taken apart, and at each moment a merge across the
        border that would have come first (lower rank, or as low and further left) means that the two never stood so.
        """
        limit = len(self.text) if limit is None else limit
        while True:
            joined = self.pair.get((one, two))
            if joined is not None and joined < limit:
                return False
            if one < self.base and two < self.base:
                return True
            if one > two:  # made after two's last part: before that its right part stood at the border
                limit, one = one, self.right[one]
            else:  # of equal merges the one further left comes first, which is the one across the border
                limit, two = two + 1, self.left[two]

    def reachable(self) -> list[bool]:
        """Which tokens their own symbols merge to; others never appear in an encoding."""
        ok = [True] * self.base
        for t in range(self.base, len(self.text)):
            ok.append(ok[self.left[t]] and ok[self.right[t]] and self.fits(self.left[t], self.right[t], t))
        return ok


class Encoder:
    """Words to token numbers by longest matches, pair checks and steps back."""

    def __init__(self, vocabulary: Vocabulary, max_pairs: int = 1 << 20):
        import ahocorasick

        self.v, self.max_pairs, self.known = vocabulary, max_pairs, {}
        self.length = [len(t) for t in vocabulary.text]
        number = {t: i for i, (t, ok) in enumerate(zip(vocabulary.text, vocabulary.reachable(), strict=True)) if ok}
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in vocabulary.text]
        self.matcher = ahocorasick.Automaton()
        for t, i in number.items():
            self.matcher.add_word(t[::-1], i)
        self.matcher.make_automaton()

    def compatible(self, key: tuple[int, int]) -> bool:
        """A cell of the pair-compatibility table that is not there yet."""
        if len(self.known) >= self.max_pairs:
            self.known.clear()
        found = self.known[key] = self.v.fits(*key)
        return found

    def encode(self, word: str) -> list[int]:
        """Token numbers (ranks) of a string of symbols, all of which the vocabulary has."""
        n, length, shorter, known = len(word), self.length, self.shorter, self.known
        longest, last = [-1] * n, n - 1
        for at, token in self.matcher.iter(word[::-1]):  # for each position the longest token that begins there
            if longest[last - at] < 0:  # longer tokens are reported first
                longest[last - at] = token
        open_ = bytearray(b"\1") * (n + 1)  # positions not yet known to be dead ends
        out, before, at, token = [], -1, 0, longest[0] if n else -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if open_[end]:
                    if before < 0:
                        break
                    fits = known.get((before, token))
                    if fits or (fits is None and self.compatible((before, token))):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                before, at = token, end
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("a symbol that the vocabulary does not have")
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else -1
        return out


#: Where normalising is lower case alone and the classes of characters never changed: below U+0180, but for U+0130.
_LATIN = re.compile("[^\x00-\u012f\u0131-\u017f]")
_CLIP = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _latin_words() -> re.Pattern:
    """The cut of ``_CLIP`` for lower-case texts of these characters."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)
    letters, numbers, space = of("L"), of("N"), "\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


class _Recent(dict):
    """Values by key, made when missing; of more than ``size`` keys those not asked for of late are forgotten."""

    def __init__(self, make: Callable[[str], bytes], size: int, longest: int):
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class TextEncoder:
    """Whole texts to the ids of a tokenizers .json file, special tokens inside texts included.

    Normalising and cutting into words are the library's, run by run between white space; where the file has the
    lower-casing normaliser and the cut of ``_CLIP``, texts of Latin characters are cut whole by the same pattern. Words are
    encoded once and kept (``max_words`` of late, of ``max_word`` letters at most).
    """

    def __init__(self, spec: str, max_words: int = 150_000, max_word: int = 60):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        self.encoder = Encoder(Vocabulary(parsed))
        library = Tokenizer.from_str(spec)
        self.normal, self.cut = library.normalizer, library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or pre_tokens(t["content"]) != [t["content"]] for t in parsed["added_tokens"]):
            raise ValueError("added tokens have to be plain strings without white space")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = {ord(c): chr(b) for c, b in byte_letters().items()}
        self.words = _Recent(self._plain, max_words, max_word)
        self.runs = _Recent(self._run, max_words // 4, max_word)
        steps = [n["type"] for n in (parsed.get("normalizer") or {}).get("normalizers", [])]
        cuts = [c.get("pattern", {}).get("Regex") for c in (parsed.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.latin = _latin_words() if steps == ["NFC", "Replace", "Lowercase"] and cuts == [_CLIP, None] else None

    def _ids(self, symbols: str) -> bytes:
        if self.encoder.v.end:
            symbols = symbols[:-1] + chr(256 + ord(symbols[-1]))
        return self.encoder.v.ids[self.encoder.encode(symbols)].tobytes()

    def _plain(self, word: str) -> bytes:
        return self._ids(word.encode().decode("latin-1"))

    def _run(self, run: str) -> bytes:
        if self.latin and not _LATIN.search(run):
            return b"".join(map(self.words.__getitem__, self.latin.findall(run.lower())))
        words = self.cut.pre_tokenize_str(self.normal.normalize_str(run) if self.normal else run)
        return b"".join(self._ids(w.translate(self.letters)) for w, _ in words)

    def __call__(self, text: str) -> np.ndarray:
        """The ids of one text."""
        found = []
        for i, piece in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                found.append(np.int32(self.special[piece]).tobytes())
            elif self.latin and not _LATIN.search(piece):
                found += map(self.words.__getitem__, self.latin.findall(piece.lower()))
            else:
                found += map(self.runs.__getitem__, pre_tokens(piece))
        return np.frombuffer(b"".join(found), np.int32)


class OffsetDecoder:
    """Ids to text: token i lies between offsets i and i + 1 of one buffer, each with the blank that joins tokens."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        if parsed.get("decoder"):
            raise ValueError("tokens are joined by blanks only where the file names no decoder")
        names = {i: t for t, i in parsed["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parsed["added_tokens"]}
        parts = [(names[i] + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.at = np.cumsum([0, *map(len, parts)])

    def __call__(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts of a batch and their offsets; ``first``: where each text's ids begin."""
        known = (ids >= 0) & (ids < len(self.at) - 1)
        known[known] = self.at[ids[known] + 1] > self.at[ids[known]]
        if not known.all():
            ids, first = ids[known], np.concatenate([[0], np.cumsum(known)])[first]
        size = self.at[ids + 1] - self.at[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes[np.arange(ends[-1]) + np.repeat(self.at[ids] - ends[:-1], size)]
        keep = np.ones(len(data), bool)
        filled = first[1:][np.diff(first) > 0]
        keep[ends[filled] - 1] = False  # no blank after the last token
        return data[keep], ends[first] - np.concatenate([[0], np.cumsum(np.diff(first) > 0)])


@lru_cache(maxsize=2)
def _encoder(spec: str) -> TextEncoder:
    return TextEncoder(spec)


@lru_cache(maxsize=2)
def _decoder(spec: str) -> OffsetDecoder:
    return OffsetDecoder(spec)


def _encode(spec, names: list[str], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(spec.value)
        for b in batches:
            for part in byte_slices(b, "__text", limit):
                ids = [encode(t.as_py() or "") for t in part.column("__text")]
                at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], lists], names=[*names, "__ids"])

    return run


def _decode(spec, names: list[str], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(spec.value)
        for b in batches:
            lists = b.column("__ids").fill_null([])
            size, at = np.diff(lists.offsets.to_numpy()), 0
            total = np.cumsum(size)
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
                part = lists[at:to]
                flat = part.flatten().to_numpy(zero_copy_only=False)
                data, off = decode(flat, np.concatenate([[0], np.cumsum(size[at:to])]))
                text = pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                own = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in names], text], names=[*names, "__text"])
                at = to

    return run


def encode_texts(df: DataFrame, path: str, *, text: str = "text", keep: list[str], ids: str = "ids", slice_bytes: int = 500_000) -> DataFrame:
    """Columns ``keep`` of ``df`` and ``ids array<int>``: what the tokenizers library's encode gives for each text.

    ``path``: a byte-level BPE file of the tokenizers library. No begin or end tokens are added, nothing is cut or padded;
    special strings inside a text are their tokens, as in the library. A null or empty text, or one of white space,
    has no ids; very long texts are read whole (a task holds ``slice_bytes`` of text or one text); equal rows stay
    separate rows; an empty table stays empty; a kept column named like the new one is a ValueError, other columns are
    not looked at. No shuffle; the tokenizer file is all that is broadcast.
    """
    return _mapped(df, path, _encode, keep, text, ids, "__text", "__ids array<int>", slice_bytes)


def decode_ids(df: DataFrame, path: str, *, ids: str = "ids", keep: list[str], text: str = "decoded", slice_ids: int = 200_000) -> DataFrame:
    """Columns ``keep`` of ``df`` and ``text``: what the library's decode gives, special tokens included.

    A null or empty list is the empty text; an id that the vocabulary does not have is passed over, as in the library;
    other cases as in ``encode_texts``.
    """
    return _mapped(df, path, _decode, keep, ids, text, "__ids", "__text string", slice_ids)


def _mapped(df: DataFrame, path: str, run, keep: list[str], given: str, made: str, inner: str, out: str, limit: int) -> DataFrame:
    if made in keep:
        raise ValueError(f"{made} is a kept column")
    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    names = [f"__k{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(given).alias(inner))
    schema = ", ".join([*[f"{n} {rows.schema[n].dataType.simpleString()}" for n in names], out])
    got = rows.mapInArrow(run(spec, names, limit), schema)
    return got.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col(out.split(" ")[0]).alias(made))


def op11(spark, sf_dir):
    """Every document encoded by word_bpe_49k.json and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = encode_texts(table(spark, sf_dir, "documents"), path, keep=["doc_id"])
    told = ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"))
    return decode_ids(told, path, keep=["doc_id", "n_tokens", "ids_sha256"]).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
