"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

A sequence of tokens is the BPE encoding of its text exactly if each two neighbours are the
encoding of their own concatenation. So the last token of the encoding of every prefix
follows from those of shorter prefixes, and what comes later can only change tokens that
begin less than the longest token's length before the end of what was read: that length is
the sufficient lookahead of the merge list. Once the prefixes that can still be continued
share a token boundary, all before it is emitted and forgotten.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself for
    the printable Latin-1 ones, else the next code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge list and what follows from it."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {(a, b): i for i, (a, b) in enumerate(m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges)}
        self.tokens = {i: t for t, i in vocab.items()}
        self._fits: dict[tuple[str, str], bool] = {}
        self._own: dict[str, bool] = {}
        #: Symbols of the longest token: so far can a token reach beyond a boundary.
        self.lookahead = max((len(self.symbols(t)) for t in vocab), default=1)

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until there is none; for short sequences."""
        none = 1 << 60
        rank = self.rank.get
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != none:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
        return parts

    def own(self, token: str) -> bool:
        """Whether the token is in the vocabulary and encodes to itself."""
        if (known := self._own.get(token)) is None:
            if len(self._own) > 200_000:
                self._own.clear()
            known = self._own[token] = token in self.vocab and self.merge(self.symbols(token)) == [token]
        return known

    def fits(self, a: str, b: str) -> bool:
        key = (a, b)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            known = self._fits[key] = self.merge(self.symbols(a) + self.symbols(b)) == [a, b]
        return known


class Encoder:
    """Encodes one word symbol by symbol: push() gives tokens that no later symbol can change."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.text = ""  # symbols not yet emitted
        self.last: list[str | None] = []  # for each end in text, the last token of that prefix's encoding
        self.previous: str | None = None  # the token emitted last

    def _token(self, upto: str, ends: list[str | None], mark: str) -> str | None:
        n = len(upto)
        for size in range(min(self.m.lookahead, n), 0, -1):
            token, start = upto[n - size :] + mark, n - size
            if not self.m.own(token):
                continue
            before = ends[start - 1] if start else self.previous
            if (start and before is None) or (before is not None and not self.m.fits(before, token)):
                continue
            return token
        return None

    def push(self, symbol: str) -> Iterator[str]:
        self.text += symbol
        self.last.append(None)
        self.last[-1] = self._token(self.text, self.last, "")
        if len(self.text) > 2 * self.m.lookahead:
            yield from self._emit()

    def _chain(self, end: int) -> list[int]:
        """The token ends of the encoding of text[:end]."""
        ends = []
        while end > 0:
            ends.append(end)
            end -= len(self.last[end - 1])
        return ends

    def _emit(self) -> Iterator[str]:
        n = len(self.text)
        shared: set[int] | None = None
        for end in range(max(1, n - self.m.lookahead), n + 1):
            if self.last[end - 1] is not None:
                own = set(self._chain(end))
                shared = own if shared is None else shared & own
        if not shared:
            return
        upto = max(shared)
        for end in reversed(self._chain(upto)):
            self.previous = self.last[end - 1]
            yield self.previous
        self.text, self.last = self.text[upto:], self.last[upto:]

    def finish(self) -> Iterator[str]:
        """The rest, with the end-of-word mark on the last symbol."""
        if not self.text:
            return
        final = self._token(self.text, self.last, self.m.suffix)
        assert final is not None, "every symbol is a token, so an encoding exists"
        body = len(self.text) - (len(final) - len(self.m.suffix))
        for end in reversed(self._chain(body)):
            yield self.last[end - 1]
        yield final


class Tokenizer:
    """What a vocabulary file of byte-level word BPE says: lower-cased NFC, white space dropped."""

    #: Distinct words whose tokens are kept, and their longest length; longer ones are streamed each time.
    KEPT, SHORT = 250_000, 40

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        self.m = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.plain = {c: self.letters[ord(c)] for c in map(chr, range(128))}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.kept: dict[str, str] = {}
        self.tokens = {str(i): t for i, t in self.m.tokens.items()} | {str(i): t for t, i in self.added.items()}

    def word(self, word: str) -> str:
        """The ids of a word, in decimal, joined by spaces."""
        letters = "".join([self.letters[b] for b in word.encode("utf-8", "surrogatepass")])
        vocab = self.m.vocab
        if len(letters) <= self.SHORT:
            parts = self.m.merge([*letters[:-1], letters[-1] + self.m.suffix])
            found = " ".join([str(vocab[p]) for p in parts])
            if len(self.kept) >= self.KEPT:
                self.kept.clear()
            self.kept[word] = found
            return found
        machine, out = Encoder(self.m), []
        for c in letters:
            out += [str(vocab[t]) for t in machine.push(c)]
        return " ".join(out + [str(vocab[t]) for t in machine.finish()])

    def words(self, text: str) -> list[str]:
        import unicodedata

        if not text.isascii():
            # The library lowers each character alone, so a capital sigma never becomes a final one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.split.findall(text.lower())

    def encode(self, text: str) -> str:
        """The ids of a text, in decimal, joined by spaces."""
        get, out = self.kept.get, []
        pieces = self.special.split(text) if self.special and any(a in text for a in self.added) else [text]
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append(str(self.added[piece]))
            else:
                out += [get(w) or self.word(w) for w in self.words(piece)]
        return " ".join(out)

    def decode_plain(self, ids: str) -> str:
        """As the library decodes with a file that names no decoder: the tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids.split()))

    def decode(self, ids: Iterator[int]) -> Iterator[str]:
        """The text, piece by piece: bytes wait only until they make a whole character."""
        import codecs

        back, machine = {c: b for b, c in enumerate(self.letters)}, codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            token = self.tokens[str(i)]
            if token in self.added:
                yield machine.decode(b"", True) + token
                machine.reset()
                continue
            ended = bool(self.m.suffix) and token.endswith(self.m.suffix) and len(token) > len(self.m.suffix)
            body = token[: -len(self.m.suffix)] if ended else token
            if text := machine.decode(bytes(back[c] for c in body)) + " " * ended:
                yield text
        if rest := machine.decode(b"", True):
            yield rest


@lru_cache(2)
def tokenizer(name: str) -> Tokenizer:
    import public_tokenizers

    return Tokenizer(public_tokenizers.path(name))


def _digests(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, names = tokenizer(name), ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for text in part.column("_text"):
                    ids = tok.encode(text.as_py())
                    out.append((ids.count(" ") + 1 if ids else 0, sha(ids), sha(tok.decode_plain(ids))))
                n, i, d = zip(*out) if out else ((), (), ())
                yield pa.record_batch([part.column("_id"), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names)

    return run


def _ids(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.record_batch([part.column("_id"), pa.array([[int(i) for i in tok.encode(t.as_py()).split()] for t in part.column("_text")], pa.list_(pa.int32()))], ["_id", "ids"])

    return run


def _texts(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.record_batch([part.column("_id"), pa.array(["".join(tok.decode(iter(i.as_py() or []))) for i in part.column("_ids")], pa.string())], ["_id", "text"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def bpe_encode(docs: DataFrame, *, name: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids array<int>, a row for each input row; null and empty texts have no ids.
    Repeated rows and null ids are kept; other columns are ignored. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    return _rows(docs, id_col, text_col).mapInArrow(_ids(name), f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def bpe_decode(encoded: DataFrame, *, name: str = "word_bpe_49k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text, a row for each input row: each word followed by a space, as the
    vocabulary has no other white space; null or no ids give an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(_texts(name), f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def bpe_digests(docs: DataFrame, *, name: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens and the SHA-256 of the ids and of the tokens' text, encoded and
    decoded in one pass without keeping the ids. Cases as in bpe_encode."""
    kind = docs.schema[id_col].dataType.simpleString()
    return _rows(docs, id_col, text_col).mapInArrow(_digests(name), f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)
