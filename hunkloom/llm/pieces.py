"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Adjacent symbols whose concatenation is a piece stand in an agenda ordered by the piece's score,
the leftmost first among equals; the best pair is merged until none is left, and symbols that
are no piece fall back to their bytes. No piece of such a vocabulary holds a blank after another
character, nor a line break, so a text is cut there into units whose merges can't touch each
other. A worker remembers units in a table of bounded size (those of the block at hand come on top), by a 64-bit hash; those of a block
of texts that it does not know are merged together, their agendas being the rows of one matrix.
All units met for the first time are also encoded and decoded by the sentencepiece library, and
so is the first whole text of each Arrow batch; any difference is an error.

Defined results: null and empty texts have no ids and decode to the empty text; a literal U+2581
counts as a blank, as in the library; texts of any length are encoded whole; repeated rows get
equal results; columns of the input are carried along, those named as an output are replaced.
Models that aren't BPE, or whose normaliser, prefix or blanks work in another way, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TextBlock, bound_batches, held, segment_sum, text_blocks, with_fields

BLANK = "▁"
#: Units that a worker remembers at most, and bytes of a unit to be merged along with others at most.
MAX_UNITS, MAX_UNIT_BYTES = 500_000, 48
#: Of these, units that stay between tasks.
REST_UNITS = 100_000


def spans(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions at[0], ..., at[0] + length[0] - 1, at[1], ..."""
    ends = np.cumsum(length)
    return np.repeat(at - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


class Codec:
    """An encoder and decoder for one model file; `path` must be readable on every executor."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            spec = pb.ModelProto.FromString(f.read())
        n = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: a merge-type model with byte fallback, a prefixed blank and no normalisation is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.pieces: dict[str, tuple[float, int]] = {}
        self.shown: list[bytes] = []
        self.bytes = [0] * 256
        for i, p in enumerate(spec.pieces):
            self.shown.append(p.piece.replace(BLANK, " ").encode())
            if p.type == p.NORMAL:
                self.pieces[p.piece] = (-p.score, i)
            elif p.type == p.BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes[value] = i
                self.shown[i] = bytes([value])
            elif p.type in (p.USER_DEFINED, p.UNUSED):
                raise ValueError(f"{path}: user-defined and unused pieces aren't supported")
            else:
                self.shown[i] = b""
        if any(BLANK in p.strip(BLANK) or p.strip(BLANK) and p.endswith(BLANK) for p in self.pieces) or any("\n" in p for p in self.pieces):
            raise ValueError(f"{path}: pieces run across blanks or lines")
        chars = {c for p in self.pieces for c in p}
        symbols = {p: i for p, (_, i) in self.pieces.items()}
        for c in sorted(chars - symbols.keys()):  # parts of pieces that aren't pieces
            symbols[c] = len(spec.pieces) + len(symbols)
        self.symbols = symbols
        pairs = {(symbols[p[:k]] << 32) | symbols[p[k:]]: (s, i) for p, (s, i) in self.pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self.pair = np.array(sorted(pairs), np.int64)
        found = [pairs[k] for k in self.pair.tolist()]
        self.pair_score = np.array([s for s, _ in found])
        self.pair_piece = np.array([i for _, i in found], np.int64)
        self.break_id = self.bytes[10]
        # known units: sorted hashes, and of each where its text of ids ("12,345,") is, its length and number of ids, whether it was met again
        self.keys = np.zeros(0, np.uint64)
        self.at, self.length, self.count = (np.zeros(0, np.int64) for _ in range(3))
        self.again = np.zeros(0, bool)
        self.pool = np.zeros(0, np.uint8)
        # and what its ids decode to
        self.shown_at, self.shown_length = (np.zeros(0, np.int64) for _ in range(2))
        self.shown_pool = np.zeros(0, np.uint8)

    def merge(self, unit: str) -> list[int]:
        """Ids of a unit whose blanks are already U+2581."""
        text = list(unit)
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        agenda: list[tuple[float, int, str]] = []

        def offer(left: int, right: int) -> None:
            whole = text[left] + text[right]
            if whole in self.pieces:
                heapq.heappush(agenda, (self.pieces[whole][0], left, whole))

        for k in range(len(text) - 1):
            offer(k, k + 1)
        while agenda:
            _, left, whole = heapq.heappop(agenda)
            right = after[left] if text[left] else len(text)
            if right >= len(text) or not text[left] or text[left] + text[right] != whole:
                continue
            text[left], text[right] = whole, ""
            after[left] = after[right]
            if after[left] < len(text):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        out: list[int] = []
        for symbol in filter(None, text):
            found = self.pieces.get(symbol)
            out += [found[1]] if found else [self.bytes[b] for b in symbol.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, with the prefixed blank still in front."""
        return self.decoded(ids).decode(errors="replace")

    def decoded(self, ids: list[int]) -> bytes:
        """What ids decode to, as bytes: those of a unit may be a part of a character."""
        return b"".join([self.shown[i] for i in ids])

    def merge_many(self, units: list[str]) -> list[str]:
        """The ids, joined by commas, of short units: row r of the matrices is unit r's agenda."""
        size = np.array([len(u) for u in units])
        width = int(size.max()) + 1
        inside = np.arange(width) < size[:, None]
        codes, back = np.unique(np.frombuffer("".join(units).encode("utf-32-le"), np.uint32), return_inverse=True)
        names = [self.symbols.get(chr(c), -2 - c) for c in codes.tolist()]
        sym = np.full((len(units), width), -1, np.int64)
        sym[inside] = np.array(names)[back]
        after = np.tile(np.arange(1, width + 1), (len(units), 1))
        before = after - 2
        score = np.full(sym.shape, np.inf)
        into = np.zeros(sym.shape, np.int64)

        def offer(r: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            a, b = sym[r, left], sym[r, right]
            key = (a << 32) | b
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            ok = (self.pair[at] == key) & (a >= 0) & (b >= 0)
            score[r, left] = np.where(ok, self.pair_score[at], np.inf)
            into[r, left] = self.pair_piece[at]

        r, left = np.nonzero(inside[:, 1:])
        offer(r, left, left + 1)
        active = np.arange(len(units))
        while len(active):
            left = score[active].argmin(1)  # the first, so the leftmost, of equal scores
            live = score[active, left] < np.inf
            active, left = active[live], left[live]
            right = after[active, left]
            sym[active, left], sym[active, right] = into[active, left], -1
            score[active, right] = np.inf
            then = after[active, right]
            after[active, left] = then
            before[active, np.minimum(then, width - 1)] = left
            offer(active, left, np.minimum(then, width - 1))
            prior = before[active, left]
            has = prior >= 0
            offer(active[has], prior[has], left[has])
        alive = inside & (sym != -1)
        texts: dict[int, str] = {}
        for v in np.unique(sym[alive]).tolist():
            if 0 <= v < len(self.shown):
                texts[v] = str(v)
            else:
                symbol = chr(-2 - v) if v < 0 else next(c for c, i in self.symbols.items() if i == v)
                texts[v] = ",".join(str(self.bytes[b]) for b in symbol.encode())
        flat, ends = [texts[v] for v in sym[alive].tolist()], np.cumsum(alive.sum(1)).tolist()
        return [",".join(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, hashes: np.ndarray, units: list[str]) -> None:
        """Encode units, hold them against the library, and add them to the known ones."""
        short = sorted((u for u in units if len(u) <= MAX_UNIT_BYTES), key=len)
        ids = {u: ",".join(map(str, self.merge(u))) for u in units if len(u) > MAX_UNIT_BYTES}
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            ids |= zip(part, self.merge_many(part), strict=True)
        line = f",{self.break_id},"
        for k in range(0, len(units), 1000):  # units in a row, a line break before each
            part = units[k : k + 1000]
            text = "\n" + "\n".join(part)
            theirs = self.library.encode(text, num_threads=1)
            if ",".join(map(str, theirs[1:])) != (line + line.join([ids[u] for u in part]))[1:]:
                raise ValueError(f"the library encodes some of {part[:20]} in another way")
            if self.decode(theirs[1:]) != text.replace(BLANK, " "):
                raise ValueError(f"some of {part[:20]} are decoded in another way")
        text = [ids[u] for u in units]
        length = np.array([len(t) + 1 for t in text], np.int64)
        at = len(self.pool) + np.cumsum(length) - length
        self.pool = np.concatenate([self.pool, np.frombuffer((",".join(text) + ",").encode(), np.uint8)])
        shown = [self.decoded([int(i) for i in t.split(",")]) for t in text]
        shown_length = np.array([len(t) for t in shown], np.int64)
        shown_at = len(self.shown_pool) + np.cumsum(shown_length) - shown_length
        self.shown_pool = np.concatenate([self.shown_pool, np.frombuffer(b"".join(shown), np.uint8)])
        spot = np.searchsorted(self.keys, hashes)
        self.shown_at, self.shown_length = np.insert(self.shown_at, spot, shown_at), np.insert(self.shown_length, spot, shown_length)
        self.keys, self.at, self.length = np.insert(self.keys, spot, hashes), np.insert(self.at, spot, at), np.insert(self.length, spot, length)
        self.count, self.again = np.insert(self.count, spot, [t.count(",") + 1 for t in text]), np.insert(self.again, spot, False)

    def forget(self, pinned: np.ndarray) -> None:
        """Keep the units that were met again since the last time, unless those are too many; those at `pinned` stay in any case."""
        keep = self.again.copy() if self.again.sum() < 2 * MAX_UNITS // 3 else np.zeros(len(self.again), bool)
        keep[pinned] = True
        self.pool = self.pool[spans(self.at[keep], self.length[keep])]
        self.shown_pool = self.shown_pool[spans(self.shown_at[keep], self.shown_length[keep])]
        self.shown_length = self.shown_length[keep]
        self.shown_at = np.cumsum(self.shown_length) - self.shown_length
        self.keys, self.length, self.count = self.keys[keep], self.length[keep], self.count[keep]
        self.at, self.again = np.cumsum(self.length) - self.length, np.zeros(len(self.keys), bool)

    def rest(self) -> None:
        """Between tasks, when others may need the memory, stay only REST_UNITS units that were met again."""
        if len(self.keys) > REST_UNITS:
            self.again &= np.cumsum(self.again) <= REST_UNITS
            self.forget(np.zeros(0, np.int64))

    def encode_block(self, block: TextBlock) -> list[tuple[bytes, int, bytes]]:
        """For each text of a block (a blank in front of each) its ids, joined by commas, their number, and what they decode to."""
        data = block.data
        if not len(data):
            return [(b"", 0, b"")] * len(block)
        blank, line = data == 32, data == 10
        start = line | blank
        start[1:] &= line[1:] | ~blank[:-1]
        start[1:] |= line[:-1]
        start[block.starts[block.starts < block.ends]] = True
        s = np.flatnonzero(start)
        e = np.r_[s[1:], len(data)]
        hashes, first, back = np.unique(block.hashes(s, e, lower=False), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        inside = spot < len(self.keys)
        new[inside] = self.keys[spot[inside]] != hashes[inside]
        self.again[spot[~new]] = True
        if new.any():
            raw = data.tobytes()
            if len(self.keys) + new.sum() > MAX_UNITS:
                self.forget(spot[~new])  # this block's units stay, so that none has to be learned twice
            self.learn(hashes[new], [raw[s[k] : e[k]].decode().replace(" ", BLANK) for k in first[new]])
            spot = np.searchsorted(self.keys, hashes)
        unit = spot[back]
        length = self.length[unit]
        out = self.pool[spans(self.at[unit], length)].tobytes()
        doc = block.doc_of(s)
        ends = np.cumsum(segment_sum(length, doc, len(block))).tolist()
        counts = segment_sum(self.count[unit], doc, len(block)).tolist()
        length = self.shown_length[unit]
        shown = self.shown_pool[spans(self.shown_at[unit], length)].tobytes()
        shown_ends = np.cumsum(segment_sum(length, doc, len(block))).tolist()
        return [(out[a : max(a, b - 1)], n, shown[c:d]) for a, b, n, c, d in zip([0, *ends[:-1]], ends, counts, [0, *shown_ends[:-1]], shown_ends, strict=True)]

    def encode(self, texts: pa.Array) -> Iterator[tuple[bytes, int, str]]:
        """For each whole text its ids, joined by commas, their number, and what they decode to.

        Each unit's ids are decoded when it is learned, and a text's decoded units joined; the prefixed blank is taken off.
        """
        blanks = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), BLANK, " ")
        one, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        front = pc.if_else(pc.equal(pc.binary_length(blanks), 0), none, pc.binary_join_element_wise(one, blanks, none))
        for block in text_blocks(front):
            for ids, n, shown in self.encode_block(block):
                yield ids, n, shown.removeprefix(b" ").decode(errors="replace")

    def check(self, text: str, ids: bytes, shown: str) -> None:
        """Hold one whole text against the library."""
        theirs = self.library.encode(text, num_threads=1)
        if ids.decode() != ",".join(map(str, theirs)) or shown != self.library.decode(theirs):
            raise ValueError(f"the library encodes or decodes {text[:80]!r} in another way")


def codec(path: str) -> Codec:
    """The worker's codec for a model file."""
    return held(path, lambda: Codec(path))


def encode_texts(docs: DataFrame, model: str, text: str = "text", keep: bool = True) -> DataFrame:
    """The rows with n_tokens, ids_sha256, decoded_sha256 and, if `keep`, ids (array) and decoded (text)."""
    new = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    docs = docs.drop(*(c for c in new if c != text))
    bound_batches(docs.sparkSession)
    schema = with_fields(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep)

    def run(it):
        c = codec(model)
        for batch in it:
            n, hashes, shown, lists, decoded = [], [], [], [], []
            column = batch.column(text)
            for k, (ids, count, own) in enumerate(c.encode(column)):
                if not k:
                    c.check(column[0].as_py() or "", ids, own)
                n.append(count)
                hashes.append(hashlib.sha256(ids).hexdigest())
                shown.append(hashlib.sha256(own.encode()).hexdigest())
                if keep:
                    lists.append(np.fromstring(ids.decode(), np.int32, sep=","))
                    decoded.append(own)
            new = [pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(shown, pa.string())] + ([pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if keep else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)
        c.rest()

    return docs.mapInArrow(run, schema)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=False).select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
