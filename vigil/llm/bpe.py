"""BPE encoding and decoding: prefix-sharing trie traversal.

A text becomes lower-case words, and the distinct new words of a batch of texts go through one trie:

* a state is the last token of the encoding of a prefix.  The encoding of a longer prefix ends in the one token
  that is a suffix of it and stays apart from the last token before it; dropping last tokens one by one
  spells the whole encoding backwards;
* the words in sorted order are the trie in depth-first order.  The path from the root to the running word is a
  stack of states; a prefix shared with the word before keeps its states, so it is computed once.

Two tokens stay apart if no merge ever crosses their seam: the tokens at the seam are followed back in time,
the later-made one first, and a merge of the two would have to come before the one that its left token
took part in (or not after the one of the right token: of equal merges the left one goes first).

Composed Latin text is split into words here.  Any other text is cut at ASCII white space, which no token crosses, and
each distinct piece goes through the library's normaliser and splitter.

No shuffle: a task keeps a bounded table of words, and a very long text is encoded in segments.  Defined results:
null and empty texts have no tokens; repeated rows are encoded row by row; special tokens in a text give their
ids, as the library does; an empty table stays empty; further columns are carried along, and one named like a
result gives way to it.  Models whose merges do not each make a token of their own are refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common as C

TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 400_000  # about 80 MB in a Python worker
CACHED_PIECES = 50_000
CACHED_PAIRS = 300_000
SEGMENT = 1 << 23  # bytes of text that share a trie
_SPACE = re.compile(r"[\x09-\x0D\x20]")
_PIECE = re.compile(r"[^\x09-\x0D\x20]+")
_NEVER = 1 << 62

# Fixed values of the tokenizer's file: its steps and its pattern
_STEPS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same pattern where a text holds nothing but ASCII, Latin-1, Latin Extended-A and General Punctuation
_OTHER = re.compile("[^\x00-\u017f\u2010-\u2027\u2030-\u205e\u20ac]")
_L, _N, _S = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\x09-\x0d\x20\x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def _byte_alphabet() -> dict[int, str]:
    """The model's character for each byte: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


_ALPHABET = _byte_alphabet()


def _mapped(word: str) -> str:
    return word.encode().decode("latin-1").translate(_ALPHABET)


class Merges:
    """The merges of a BPE model, by token id."""

    def __init__(self, model: dict):
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain BPE model: {model['type']} {odd}")
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        self.length: dict[int, int] = {}
        joined = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        results = {a + b for a, b in joined}
        closed = {}
        for token, i in vocab.items():
            if token not in results:  # one symbol, or one symbol that ends a word
                self.made[i], closed[i] = -1, bool(self.end) and len(token) > 1 and token.endswith(self.end)
                self.length[i] = 1
        alive = set(self.made)
        for r, (a, b) in enumerate(joined):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            if t in self.made or x not in self.made or y not in self.made or closed[x]:
                raise ValueError(f"merge {r} does not make a token of its own")
            self.rank[x, y], self.parts[t], self.made[t] = r, (x, y), r
            closed[t], self.length[t] = closed[y], self.length[x] + self.length[y]
            if x in alive and y in alive and not self._crossed(x, y, inside=True):
                alive.add(t)  # others never come out of the merges
        self.inner = {s: i for s, i in vocab.items() if i in alive and not closed[i]}
        self.last = {s[: len(s) - len(self.end)]: i for s, i in vocab.items() if i in alive and closed[i]} if self.end else self.inner
        self.inner_lengths, self.last_lengths = self._by_tail(self.inner), self._by_tail(self.last)
        self.pairs: dict[int, bool] = {}  # left token x 2^32 + right token

    def _crossed(self, x: int, y: int, inside: bool = False) -> bool:
        """Whether a merge crosses the seam of two tokens; ``inside``: before they are merged themselves."""
        before_x = before_y = _NEVER  # when the token at the seam was merged away
        while True:
            r = None if inside else self.rank.get((x, y))
            if r is not None and r < before_x and r <= before_y:
                return True
            inside = False
            made_x, made_y = self.made[x], self.made[y]
            if made_x < 0 and made_y < 0:
                return False
            if made_x >= made_y:
                before_x, x = made_x, self.parts[x][1]
            else:
                before_y, y = made_y, self.parts[y][0]

    def apart(self, x: int, y: int) -> bool:
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        found = self.pairs[x << 32 | y] = not self._crossed(x, y)
        return found

    def _by_tail(self, tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """Lengths of the tokens of four symbols and more, longest first, by their last four."""
        lengths: dict[str, set[int]] = {}
        for token, i in tokens.items():
            if len(token) >= 4 and self.length[i] == len(token):
                lengths.setdefault(token[-4:], set()).add(len(token))
        return {tail: tuple(sorted(n, reverse=True)) for tail, n in lengths.items()}

    def _ending(self, word: str, end: int, tokens: dict[str, int], lengths: dict[str, tuple[int, ...]], path: list[int]) -> int:
        """The last token of ``word[:end]``, given the states of all shorter prefixes."""
        pairs = self.pairs
        if end > 3:
            for n in lengths.get(word[end - 4: end], ()):
                if n <= end and (token := tokens.get(word[end - n: end])) is not None:
                    if n == end:
                        return token
                    found = pairs.get((before := path[end - n - 1]) << 32 | token)
                    if self.apart(before, token) if found is None else found:
                        return token
        for n in (3, 2):
            if n <= end and (token := tokens.get(word[end - n: end])) is not None:
                if n == end:
                    return token
                found = pairs.get((before := path[end - n - 1]) << 32 | token)
                if self.apart(before, token) if found is None else found:
                    return token
        if (token := tokens.get(word[end - 1])) is None:
            raise ValueError(f"no token for {word[end - 1]!r}")
        return token  # one symbol: no longer token stays apart from what is before it

    def encode(self, words) -> dict[str, list[int]]:
        """Token ids of distinct words, by one depth-first pass over their trie."""
        out, path, before = {}, [], ""
        for word in sorted(words):
            shared, top = 0, min(len(path), len(word) - 1)
            while shared < top and word[shared] == before[shared]:
                shared += 1
            del path[shared:]
            for end in range(shared + 1, len(word)):
                path.append(self._ending(word, end, self.inner, self.inner_lengths, path))
            before = word
            at, ids = len(word), []
            token = self._ending(word, at, self.last, self.last_lengths, path) if word else None
            while token is not None:
                ids.append(token)
                at -= self.length[token]
                token = path[at - 1] if at else None
            out[word] = ids[::-1]
        return out


class Codec:
    """Encoder and decoder of one tokenizer file, with a bounded table of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.merges = Merges(layout["model"])
        added = layout.get("added_tokens") or []
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in added):
            raise ValueError("added tokens must be plain special tokens without white space")
        if layout.get("decoder"):
            raise ValueError("tokens are joined by one space; decoders are not built")
        self.special = {t["content"]: t["id"] for t in added}
        self.special_in = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        split = (layout.get("pre_tokenizer") or {}).get("pretokenizers") or []
        steps = [x["type"] for x in (layout.get("normalizer") or {}).get("normalizers") or []]
        plain = (steps == _STEPS and [x["type"] for x in split] == ["Split", "ByteLevel"]
                 and split[0]["pattern"].get("Regex") == _PATTERN and split[0]["invert"] and not split[1]["add_prefix_space"])
        if not plain:
            raise ValueError("unknown normaliser or splitter: its pieces may cross white space")
        vocab = layout["model"]["vocab"]
        self.token = {**{i: s.encode() for s, i in vocab.items()}, **{i: s.encode() for s, i in self.special.items()}}
        self.known: dict[str, list[str | int]] = {}  # words of pieces
        self.seen: dict[str | int, bytes] = {}  # ids of words

    def words(self, piece: str) -> list[str | int]:
        """Words of a piece by the library, back in their own characters, and the ids of special tokens."""
        out: list[str | int] = []
        for part in self.special_in.split(piece) if self.special_in else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = self.normalizer.normalize_str(part)
                out += [part[lo:hi] for _, (lo, hi) in self.splitter.pre_tokenize_str(part)]
        return out

    def split(self, text: str) -> list[str | int]:
        """Lower-case words of a text, and the ids of special tokens."""
        if "<|" not in text and not _OTHER.search(text) and unicodedata.is_normalized("NFC", text):
            return _LATIN.findall(text.lower())
        out: list[str | int] = []
        known = self.known
        for piece in _PIECE.findall(text):
            words = known.get(piece)
            if words is None:
                words = self.words(piece)
                if len(piece) <= 64:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = words
            out += words
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each text: new words of all texts share one trie."""
        split = [self.split(t) for t in texts]
        seen = self.seen
        new = set().union(*split).difference(seen)
        if len(seen) + len(new) > CACHED_WORDS:
            seen.clear()
            new = set().union(*split)
        mapped = {}
        for word in new:
            if isinstance(word, int):
                seen[word] = array("I", (word,)).tobytes()
            else:
                mapped[word] = word if word.isascii() and word.isprintable() else _mapped(word)
        ids = self.merges.encode(set(mapped.values()))
        seen.update((word, array("I", ids[own]).tobytes()) for word, own in mapped.items())
        out = [b"".join([seen[w] for w in words]) for words in split]
        for word in mapped:
            if len(word) > 64:
                del seen[word]
        return out

    def decode(self, ids) -> bytes:
        """Tokens joined by one space; unknown ids are skipped."""
        get = self.token.get
        return b" ".join([t for t in map(get, ids) if t is not None])


_CODECS: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _segments(text: str):
    """A text in parts that end before white space."""
    lo = 0
    while lo < len(text):
        space = _SPACE.search(text, lo + SEGMENT) if lo + SEGMENT < len(text) else None
        hi = space.start() if space else len(text)
        yield text[lo:hi]
        lo = hi


def encode(df: DataFrame, text_col: str, keep: list[str], tokenizer: str | None = None, with_decoded: bool = False) -> DataFrame:
    """``keep`` columns of every row with ``ids`` and, if asked for, the text that they decode to."""
    made = ("ids", "decoded")[: 1 + with_decoded]
    keep = C.apart(keep, made)
    source = df.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        own = codec(tokenizer)
        for batch in batches:
            for lo, hi, buf, bounds in C.text_groups(batch, "__text", SEGMENT):
                texts = [buf[bounds[r]: bounds[r + 1]].tobytes().decode("utf-8", "replace") for r in range(hi - lo)]
                if len(buf) > SEGMENT and hi - lo == 1:
                    ids = [b"".join(own.encode([part])[0] for part in _segments(texts[0]))]
                else:
                    ids = own.encode(texts)
                cut = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                columns = [batch.column(c).slice(lo, hi - lo) for c in keep] + [pa.ListArray.from_arrays(pa.array(cut), values)]
                if with_decoded:
                    columns.append(pa.array([own.decode(memoryview(x).cast("I")) for x in ids], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])

    return C.map_arrow(source, run, C.with_columns(source, keep, ", ".join(("ids array<int>", "decoded string")[: len(made)])))


def decode(df: DataFrame, ids_col: str, keep: list[str], tokenizer: str | None = None) -> DataFrame:
    """``keep`` columns of every row with ``decoded``: null for null ids."""
    keep = C.apart(keep, ("decoded",))
    source = df.select(*[F.col(c) for c in keep], F.col(ids_col).alias("__ids"))

    def run(batches):
        own = codec(tokenizer)
        for batch in batches:
            out = []
            for ids in batch.column("__ids"):  # one row's ids at a time
                out.append(own.decode(ids.values.to_pylist()).decode() if ids.is_valid else None)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(out, pa.string())], names=[*keep, "decoded"])

    return C.map_arrow(source, run, C.with_columns(source, keep, "decoded string"))
