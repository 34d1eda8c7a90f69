"""BPE encoding and decoding of whole texts with a public word-level BPE vocabulary (tokenizers JSON).

Short texts are encoded where they are read. Long texts are cut into leaves which are spread over the cluster and
encoded in parallel: ordinary text is cut between pre-tokens, where the encodings of both sides are independent, and a
long unsplit run (one pre-token of thousands of characters) is cut anywhere. The leaves of a run are concatenated as a
tree: around each join a growing window is encoded again until its first token is the left side's and its last token
the right side's. An encoding is the exact one when each pair of neighbours encodes to itself; pairs within either side
and within the window do, so agreement at both ends proves the joined encoding.

Defined cases: null or empty text has no tokens; copies and repeated ids give a row each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.common import materialize, slices, tokenizer_path
from ragmill.session import ship

LEAF = 16_384  # characters of a leaf; longer texts are spread over the cluster
RUN = 2_048  # a pre-token longer than this is cut into leaves of its own
CACHE = 100_000  # pre-tokens in each of a worker's two generations of remembered ones

#: The pre-token pattern of the vocabulary file, with its white space spelled out.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WS}\p{{L}}\p{{N}}]+"


def _byte_table() -> dict[int, str]:
    """Bytes to printable characters: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return table


class WordBpe:
    """One worker's encoder: the vocabulary's own normaliser and merges, with a cache by pre-token. The file is looked up
    where the worker runs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        path = tokenizer_path(path)
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.ids = vocab | self.special
        self.open_model = functools.cache(lambda: models.BPE(vocab=vocab, merges=merges))  # made only for a long run
        self.bytes = str.maketrans({chr(b): c for b, c in _byte_table().items()})
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}
        self.long = regex.compile(rf"[^{_WS}]{{{RUN + 1},}}")
        self.space = regex.compile(rf"[{_WS}]")
        self.wide = re.compile("[^\x00-\u024f]")
        self.counts: dict[str, int] = {}
        self.old_counts: dict[str, int] = {}

    def normalize(self, part: str) -> str:
        """The file's normaliser. Below U+0250 there are no combining marks and no letters whose lower case depends on
        their neighbours, so composing changes nothing and str.lower() is the same."""
        return part.lower() if part.isascii() or not self.wide.search(part) else self.tok.normalizer.normalize_str(part)

    def symbols(self, piece: str) -> str:
        return piece.encode("utf-8").decode("latin-1").translate(self.bytes)

    def tokens(self, symbols: str, closed: bool) -> list[str]:
        """Tokens of a run of symbols; closed: the word ends here, else (inner leaves of a run) no word end is added."""
        if not symbols:
            return []
        return [t.value for t in (self.tok.model if closed else self.open_model()).tokenize(symbols)]

    def row(self, tokens: list[str]) -> tuple[int, str, str]:
        return len(tokens), " ".join(str(self.ids[t]) for t in tokens), " ".join(tokens)

    def piece(self, piece: str) -> tuple[int, str, str]:
        if (got := self.cache.get(piece)) is None:
            if len(piece) > RUN:
                return self.row(self.run([piece[i : i + RUN] for i in range(0, len(piece), RUN)]))
            if (got := self.old.get(piece)) is None:
                got = self.row(self.tokens(self.symbols(piece), True))
            if len(self.cache) >= CACHE:  # what is used again moves on to the new generation
                self.old, self.cache = self.cache, {}
            self.cache[piece] = got
        return got

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """(normalised text, False) and (special token, True) in order."""
        for part in self.splitter.split(text) if self.splitter else [text]:
            if part in self.special:
                yield part, True
            elif part:
                yield self.normalize(part), False

    def pieces(self, normalized: str) -> list[tuple[int, str, str]]:
        get, piece = self.cache.get, self.piece
        return [get(p) or piece(p) for p in self.pattern.findall(normalized)]

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids joined by spaces, decoded text."""
        out: list[tuple[int, str, str]] = []
        for part, special in self.parts(text):
            out += [(1, str(self.special[part]), part)] if special else self.pieces(part)
        return sum(p[0] for p in out), " ".join([p[1] for p in out]), " ".join([p[2] for p in out])

    def count(self, piece: str) -> int:
        """Number of tokens of a pre-token."""
        if (n := self.old_counts.get(piece)) is None:
            n = self.piece(piece)[0] if len(piece) > RUN else len(self.tok.model.tokenize(self.symbols(piece)))
        if len(self.counts) >= 2 * CACHE:
            self.old_counts, self.counts = self.counts, {}
        self.counts[piece] = n
        return n

    def length(self, text: str) -> int:
        n, count = 0, self.count
        for part, special in self.parts(text):
            if special:
                n += 1
            else:
                get = self.counts.get
                n += sum([get(p) or count(p) for p in self.pattern.findall(part)])
        return n

    def join(self, left: list[str], right: list[str], closed: bool) -> list[str]:
        """Concatenate two encodings of neighbouring symbols; closed: right ends the word."""
        w = 1
        while True:
            a, b = left[-w:], right[:w]
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            symbols = "".join(a + b)
            ends = closed and whole_right
            if ends and self.suffix:
                symbols = symbols.removesuffix(self.suffix)
            window = self.tokens(symbols, ends)
            if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            w *= 2

    def tree(self, leaves: list[list[str]]) -> list[str]:
        """Join the encoded leaves of one run pair by pair, level by level."""
        while len(leaves) > 1:
            last = len(leaves) - 2
            leaves = [self.join(leaves[i], leaves[i + 1], i >= last) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def run(self, segments: list[str]) -> list[str]:
        return self.tree([self.tokens(self.symbols(s), i == len(segments) - 1) for i, s in enumerate(segments)])

    def leaves(self, text: str, leaf: int) -> Iterator[tuple[str, str]]:
        """(kind, payload): special token; text cut between pre-tokens; halves of a long run; the run's last half."""
        for part, special in self.parts(text):
            if special:
                yield "special", part
                continue
            start = 0
            if not self.long.search(part):  # no run to halve: cut at white space
                while (m := self.space.search(part, start + leaf)) and m.start() < len(part):
                    yield "text", part[start : m.start()]
                    start = m.end()
                if part[start:].strip():
                    yield "text", part[start:]
                continue
            for m in self.pattern.finditer(part):
                if m.end() - m.start() > RUN:
                    if part[start : m.start()].strip():
                        yield "text", part[start : m.start()]
                    halves = split_run(m.group(), RUN)
                    for i, h in enumerate(halves):
                        yield "last" if i == len(halves) - 1 else "run", h
                    start = m.end()
                elif m.end() - start >= leaf:
                    yield "text", part[start : m.end()]
                    start = m.end()
            if part[start:].strip():
                yield "text", part[start:]


def split_run(run: str, limit: int) -> list[str]:
    """Halve until no part is longer than the limit."""
    if len(run) <= limit:
        return [run]
    mid = len(run) // 2
    return split_run(run[:mid], limit) + split_run(run[mid:], limit)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _short(path: str, keep_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            rows = [enc.encode(t or "") for t in b.column("_text").to_pylist()]
            cols = [b.column("_id"), pa.array([r[0] for r in rows], pa.int64())]
            cols += [pa.array([r[k] if keep_text else _sha(r[k]) for r in rows], pa.string()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "n_tokens", "ids", "decoded"])

    return work


def _cut(path: str, leaf: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, 8):
            for rid, doc, text in zip(*(b.column(c).to_pylist() for c in ("_rid", "_id", "_text")), strict=True):
                got = list(enc.leaves(text, leaf)) or [("text", "")]
                n = len(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid] * n, pa.int64()), pa.array([doc] * n, b.schema.field("_id").type), pa.array(range(n), pa.int32()), pa.array([g[0] for g in got]), pa.array([g[1] for g in got])],
                    names=["_rid", "_id", "seq", "kind", "payload"],
                )

    return work


def _leaf(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, 32):
            n, ids, toks = [], [], []
            for kind, payload in zip(b.column("kind").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if kind == "special":
                    r = (1, str(enc.special[payload]), payload)
                elif kind == "text":
                    got = enc.pieces(payload)
                    r = sum(p[0] for p in got), " ".join(p[1] for p in got), " ".join(p[2] for p in got)
                else:
                    t = enc.tokens(enc.symbols(payload), kind == "last")
                    r = len(t), "", " ".join(t)  # ids follow once the run is joined
                n.append(r[0])
                ids.append(r[1])
                toks.append(r[2])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("_rid", "_id", "seq", "kind")] + [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(toks, pa.string())], names=["_rid", "_id", "seq", "kind", "n", "ids", "toks"])

    return work


def _joined(path: str, keep_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, 8):
            rows = []
            for leaves in b.column("leaves").to_pylist():
                out: list[tuple[int, str, str]] = []
                run: list[list[str]] = []
                for x in leaves:
                    if x["kind"] in ("run", "last"):
                        run.append(x["toks"].split(" "))
                        if x["kind"] == "last":
                            out.append(enc.row(enc.tree(run)))
                            run = []
                    elif x["n"]:
                        out.append((x["n"], x["ids"], x["toks"]))
                rows.append((sum(o[0] for o in out), " ".join(o[1] for o in out), " ".join(o[2] for o in out)))
            cols = [b.column("_id"), pa.array([r[0] for r in rows], pa.int64())]
            cols += [pa.array([r[k] if keep_text else _sha(r[k]) for r in rows], pa.string()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "n_tokens", "ids", "decoded"])

    return work


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, digests: bool = False) -> DataFrame:
    """Encode and decode each text: id, n_tokens, ids (decimal, joined by a space) and decoded, or their SHA-256 digests.

    One row per input row; null and empty texts have no tokens."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = dict(base.dtypes)["_id"]
    out = f"_id {kind}, n_tokens long, ids string, decoded string"
    short = base.where(F.length("_text") <= leaf).mapInArrow(_short(path, not digests), out)
    # written, so that a task that runs again gives its texts the same numbers
    long = materialize(base.where(F.length("_text") > leaf).withColumn("_rid", F.monotonically_increasing_id()), "bpe-long")
    leaves = long.mapInArrow(_cut(path, leaf), f"_rid long, _id {kind}, seq int, kind string, payload string").repartition("_rid", "seq")
    encoded = leaves.mapInArrow(_leaf(path), f"_rid long, _id {kind}, seq int, kind string, n long, ids string, toks string")
    # the leaves of one text only: bounded by the text
    whole = encoded.groupBy("_rid").agg(F.first("_id").alias("_id"), F.sort_array(F.collect_list(F.struct("seq", "kind", "n", "ids", "toks"))).alias("leaves"))
    both = short.unionByName(whole.select("_id", "leaves").mapInArrow(_joined(path, not digests), out))
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return both.select(F.col("_id").alias(id_col), "n_tokens", F.col("ids").alias(names[0]), F.col("decoded").alias(names[1]))


def _lengths(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([enc.length(t or "") for t in b.column("_text").to_pylist()], pa.int64())], names=["length"])

    return work


def encoded_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """One row (length) per input row: its number of tokens, 0 for null and empty texts."""
    ship(docs.sparkSession)
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(_lengths(path), "length long")
