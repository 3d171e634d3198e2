"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

For a fixed merge list the encoding of every prefix has one last token: the token t ending there
that is compatible with the last token of the prefix before it.  Two tokens are compatible when the
merges, applied to their concatenation, give the two tokens back; the merge trees of both, walked
down from the boundary in order of rank, decide it.  So the transducer reads one symbol at a time
and keeps, for each recent prefix, its last token.

The lookahead follows from the merge list: no later token reaches back further than the longest
token, so only the last `lookahead` prefixes can still be extended.  A token on which all of their
chains agree is stable and is emitted, and what lies before it is forgotten; memory does not grow
with the text.  Encodings of whole words are memoised in a table of fixed size.

Decoding is a state machine over ids: it holds at most an incomplete UTF-8 sequence.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm._common import slices, table

#: What a worker remembers, of a partition or of all it comes to: words and pretokens in two generations each, and pairs of tokens.
MEMO_WORDS, MEMO_PRETOKENS, MEMO_PAIRS = 80_000, 300_000, 400_000
#: Longer pretokens are streamed and not remembered.
MEMO_CHARS = 64
#: Characters of a text that are cut into words, and encoded, at a time.
PIECE = 1 << 17
#: Unicode's White_Space; Python's own str.split() also cuts at U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, other = [""] * 256, 0
    for b in range(256):
        if b in plain:
            symbols[b] = chr(b)
        else:
            symbols[b] = chr(256 + other)
            other += 1
    return symbols


class MergeList:
    """The vocabulary, the merge tree of each token, and what can be derived from them."""

    def __init__(self, definition: dict):
        model = definition["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.made: dict[str, tuple[int, str, str]] = {}
        for k, (a, b) in enumerate(merges):
            self.made.setdefault(a + b, (k, a, b))
        self.added: dict[str, int] = {t["content"]: t["id"] for t in definition.get("added_tokens", [])}
        #: Symbols that a token can span, and so how far back a later token can reach.
        self.lookahead = max((len(t.removesuffix(self.suffix)) for t in self.ids), default=1)
        self._right: dict[str, list] = {}
        self._left: dict[str, list] = {}
        self._sound: dict[str, bool] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        #: Sound tokens by their symbols, inside a word and at its end, and what is known of pairs of their ids.
        sound = [t for t in self.ids if self.sound(t)]
        self.inner = {t: self.ids[t] for t in sound if not self.suffix or not t.endswith(self.suffix)}
        self.final = {t.removesuffix(self.suffix): self.ids[t] for t in sound if not self.suffix or t.endswith(self.suffix)}
        self.spelling = {i: t for t, i in self.ids.items()}
        self.known: dict[int, bool] = {}

    def _spine(self, token: str, side: int, memo: dict[str, list]) -> list[tuple[str, int, int]]:
        """The pieces at one edge of a token: (piece, rank that forms it, rank that uses it up), the token first."""
        spine = memo.get(token)
        if spine is None:
            spine, piece, used = [], token, _NEVER
            while True:
                formed, *parts = self.made.get(piece, (-1, "", ""))
                spine.append((piece, formed, used))
                if formed < 0:
                    break
                piece, used = parts[side], formed
            memo[token] = spine  # one for each token of the vocabulary at most
        return spine

    def compatible(self, first: str, second: str) -> bool:
        """Whether no merge ever crosses the boundary between the two tokens."""
        known = self._pairs.get((first, second))
        if known is None:
            known = self._compatible(first, second)
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            self._pairs[first, second] = known
        return known

    def remember(self, pair: int, first: int, second: int) -> bool:
        """`compatible` for two ids, kept under their joint number."""
        if len(self.known) >= MEMO_PAIRS:
            self.known.clear()
        fits = self.known[pair] = self._compatible(self.spelling[first], self.spelling[second])
        return fits

    def _compatible(self, first: str, second: str) -> bool:
        left, right = self._spine(first, 1, self._right), self._spine(second, 0, self._left)
        rank, i, j = self.rank, 0, 0
        while True:
            a, formed_a, used_a = left[i]
            b, formed_b, used_b = right[j]
            crossing = rank.get((a, b))
            # of equal merges the leftmost comes first: the one inside `first` before the crossing, the crossing before the one inside `second`
            if crossing is not None and crossing < used_a and crossing <= used_b:
                return False
            if formed_a < 0 and formed_b < 0:
                return True
            if formed_a > formed_b:
                i += 1
            else:
                j += 1

    def sound(self, token: str) -> bool:
        """Whether the merges, applied to the token's own symbols, give the token."""
        known = self._sound.get(token)
        if known is None:
            made = self.made.get(token)
            known = made is None or (self.sound(made[1]) and self.sound(made[2]) and self._until(made))
            self._sound[token] = known
        return known

    def _until(self, made: tuple[int, str, str]) -> bool:
        """Whether the two parts of a merge meet as they are, with no other crossing before."""
        k, first, second = made
        left, right = self._spine(first, 1, self._right), self._spine(second, 0, self._left)
        i = j = 0
        while True:
            a, formed_a, used_a = left[i]
            b, formed_b, used_b = right[j]
            crossing = self.rank.get((a, b))
            if (i or j) and crossing is not None and crossing < used_a and crossing <= used_b:
                return False
            if formed_a < 0 and formed_b < 0:
                return True
            if formed_a > formed_b:
                i += 1
            else:
                j += 1


class Transducer:
    """Encodes one pretoken, symbol by symbol; `feed` and `finish` return ids that are stable."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.text, self.cut = "", 0
        #: For each prefix from `cut` on: its last token and where that token starts.
        self.last: list[tuple[str, int]] = [("", -1)]
        self.held = ""

    def _step(self, symbol: str, final: bool) -> None:
        merges, last = self.m, self.last
        self.text += symbol
        end, tail = len(self.text), merges.suffix if final else ""
        for start in range(max(0, end - merges.lookahead), end):
            if last[start] is None:
                continue
            token = self.text[start:end] + tail
            if token in merges.ids and merges.sound(token) and (last[start][1] < 0 or merges.compatible(last[start][0], token)):
                last.append((token, start))
                return
        last.append(None)  # no vocabulary entry ends here

    def run(self, symbols: str) -> list[int]:
        """A whole short pretoken at once: the same steps in one loop, nothing to emit before its end."""
        merges, n = self.m, len(symbols)
        reach, known, inner = merges.lookahead, merges.known, merges.inner
        ids, froms = [0] * (n + 1), [-1] * (n + 1)
        for end in range(1, n + 1):
            find = (merges.final if end == n else inner).get
            for start in range(end - reach if end > reach else 0, end):
                token = find(symbols[start:end])
                if token is None:
                    continue
                if start:
                    if froms[start] < 0:
                        continue
                    pair = ids[start] << 20 | token
                    fits = known.get(pair)
                    if fits is None:
                        fits = merges.remember(pair, ids[start], token)
                    if not fits:
                        continue
                ids[end], froms[end] = token, start
                break
        out, at = [], n
        while at > 0:
            out.append(ids[at])
            at = froms[at]
        return out[::-1]

    def _chain(self, at: int) -> list[int]:
        """The starts of the tokens that encode the prefix, from its end backwards."""
        starts = []
        while at > 0:
            at = self.last[at][1]
            starts.append(at)
        return starts

    def _take(self, upto: int) -> list[int]:
        out, at = [], upto
        while at > 0:
            token, at = self.last[at]
            out.append(self.m.ids[token])
        return out[::-1]

    def feed(self, symbols: str) -> list[int]:
        """Reads symbols; returns the ids that no continuation can change any more."""
        out: list[int] = []
        for symbol in symbols:
            if self.held:
                self._step(self.held, False)
            self.held = symbol
            if len(self.text) >= 64 * self.m.lookahead:
                out += self._emit()
        return out

    def _emit(self) -> list[int]:
        end = len(self.text)
        live = [at for at in range(end - self.m.lookahead + 1, end + 1) if self.last[at] is not None]
        agreed = set(self._chain(live[0])) | {live[0]}
        for at in live[1:]:
            agreed &= {at, *self._chain(at)}
        stable = max(agreed)
        out = self._take(stable)
        if stable:
            anchor = self.last[stable][0]
            self.text = self.text[stable:]
            self.last = [(anchor, 0) if k == 0 else (x and (x[0], x[1] - stable)) for k, x in enumerate(self.last[stable:])]
        return out

    def finish(self) -> list[int]:
        """The ids of what is left, the last symbol being the end of the word."""
        if self.held:
            self._step(self.held, True)
            self.held = ""
        return self._take(len(self.text))


class Memo(dict):
    """A table of bounded size: when full, it becomes the old generation, from which what is used comes back."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Text to ids and back; each worker process has one for each vocabulary file."""

    def __init__(self, definition: dict):
        self.m = MergeList(definition)
        self.symbols = byte_symbols()
        self.of_symbol = {s: b for b, s in enumerate(self.symbols)}
        split = next(p["pattern"]["Regex"] for p in definition["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pretokens = regex.compile(split.replace("\\s", SPACE)).findall
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.m.added, key=len, reverse=True))) + ")") if self.m.added else None
        self.tokens = {i: t for t, i in self.m.ids.items()} | {i: t for t, i in self.m.added.items()}
        self.by_word, self.by_pretoken = Memo(self._word, MEMO_WORDS), Memo(self._pretoken, MEMO_PRETOKENS)

    def forget(self) -> None:
        """Drops what was remembered of texts, so that an idle worker holds the vocabulary alone."""
        for memo in (self.by_word, self.by_pretoken):
            memo.clear()
            memo.old = {}
        self.m.known.clear()
        self.m._pairs.clear()

    def _pretoken(self, pretoken: str) -> bytes:
        mapped = "".join(map(self.symbols.__getitem__, pretoken.encode("utf-8", "replace")))
        machine = Transducer(self.m)
        return array("I", machine.run(mapped) if len(mapped) <= 4 * MEMO_CHARS else machine.feed(mapped) + machine.finish()).tobytes()

    def _word(self, word: str) -> bytes:
        plain = word if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ")
        return b"".join(map(self.by_pretoken.__getitem__, self.pretokens(plain.lower())))

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids as little-endian unsigned 32-bit integers, in pieces."""
        ids_of = self.by_word.__getitem__
        for k, part in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                yield array("I", [self.m.added[part]]).tobytes()
                continue
            start, odd = 0, regex.search("[\x1c-\x1f]", part)
            while start < len(part):
                found = self.spaces.search(part, start + PIECE) if start + PIECE < len(part) else None
                end = found.start() if found else len(part)
                yield b"".join(map(ids_of, part[start:end].split() if not odd else [w for w in self.spaces.split(part[start:end]) if w]))
                start = end

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' own spelling joined by a space, as a tokenizer without a decoder has it."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def decode_text(self, ids: Iterable[int]) -> Iterator[str]:
        """The text that the tokens spell: byte symbols become bytes, an end of word becomes a space."""
        machine, suffix = codecs.getincrementaldecoder("utf-8")(errors="replace"), self.m.suffix
        special = set(self.m.added.values())
        for i in ids:
            if i in special:
                yield machine.decode(b"", final=True) + self.tokens[i]
                machine.reset()
                continue
            token = self.tokens[i]
            ends = bool(suffix) and token.endswith(suffix)
            out = machine.decode(bytes(map(self.of_symbol.__getitem__, token.removesuffix(suffix) if ends else token)))
            yield out + " " if ends else out
        yield machine.decode(b"", final=True)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text); null counts as empty."""
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        for piece in self.encode(text or ""):
            if piece:
                of_ids.update(piece)
                of_text.update(((" " if n else "") + self.decode(memoryview(piece).cast("I"))).encode())
                n += len(piece) // 4
        return n, of_ids.hexdigest(), of_text.hexdigest()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, kept by the process; a file that is not there is looked for among Spark's files."""
    if path not in _CODECS:
        try:
            with open(path, encoding="utf-8") as file:
                definition = json.load(file)
        except FileNotFoundError:
            with open(SparkFiles.get(path.rsplit("/", 1)[-1]), encoding="utf-8") as file:
                definition = json.load(file)
        _CODECS[path] = Codec(definition)
    return _CODECS[path]


def vocabulary() -> str:
    """The path of the vocabulary that the registered query uses."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def digests(documents: DataFrame, path: str, remember: bool = False) -> DataFrame:
    """For each row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The whole text is encoded; a null text counts as empty and has no tokens.  Repeated rows get
    equal results, a null doc_id is carried along, an empty table gives an empty result, and
    columns other than doc_id and text are not read.  With `remember` a worker keeps its tables of
    encodings from one partition to the next; they are of fixed size, but stay while it idles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in slices(batches, 4096):
            rows = [coder.digest(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if not remember:
            coder.forget()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(documents: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with their ids as an array of int; a column of the same name as `ids` is replaced."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        coder = codec(path)
        return pa.array([array("I", b"".join(coder.encode(t.as_py() or ""))).tolist() for t in texts], pa.list_(pa.int32()))

    return documents.withColumn(ids, run(F.col(text)))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the text that their ids spell; null ids give an empty text."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        coder = codec(path)
        return pa.array(["".join(coder.decode_text(x.as_py() or [])) for x in lists], pa.string())

    return rows.withColumn(text, run(F.col(ids)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary(), remember=True)
