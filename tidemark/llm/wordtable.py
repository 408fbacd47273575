"""Byte-pair encoding and decoding through a table of distinct words.

All texts are split into words, every distinct word is encoded once, and its
ids join back to the places where it stands. Decoding joins ids to pieces. The
words seen most (at most `head`, a documented bound) travel to all tasks as
packed arrays of hashes and ids; the places of all other words meet the word
table in a shuffle and return to their document. Words are compared by bytes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .common import WordModel, as_list, byte_letters, in_batches, joined_values

HEAD = 4_000_000
# The id that stands for a word outside the head.
HOLE = 0xFFFFFFFF
# The code points of Unicode's White_Space property (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BEFORE_SPACE = [c + " " for c in WHITE]
# The byte-level vocabulary's split pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The usual chunks, told without that pattern: letters of ASCII and Latin-1, then ASCII signs but the apostrophe.
_USUAL = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class Splitter:
    """Cuts a text into chunks (for caching) and chunks into words, as the vocabulary's splitter does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex

        form = json.loads(Path(path).read_text(encoding="utf-8"))
        pre = form["pre_tokenizer"]
        if form["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level vocabulary without normaliser is needed")
        self.vocab = form["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in form["added_tokens"]}
        self.find = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]

    def joined(self, text: str) -> bool:
        """Whether a space stands after white space or at the end, where it may join it to one word."""
        return text.endswith(" ") or any(pair in text for pair in _BEFORE_SPACE)

    def chunks(self, text: str | None) -> list[str]:
        """Special tokens, and pieces that no word crosses."""
        if not text:
            return []
        out: list[str] = []
        for s in self.cut(text) if any(x in text for x in self.special) else [text]:
            if s in self.special or not s:
                out += [s] * bool(s)
            elif self.joined(s):  # not cut at spaces
                out.append(s)
            else:
                first, *rest = s.split(" ")
                out += [first] * bool(first)
                out += [" " + r for r in rest]
        return out

    def numbered(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct chunks of all texts, the chunks of each in order by number, and where each text's numbers end.

        A text that does not begin with a space may count an empty chunk; so do null and empty ones.
        """
        odd = {i: self.chunks(t) for i, t in enumerate(texts) if t and (self.joined(t) or any(x in t for x in self.special))}
        split = pc.split_pattern(pa.array(["" if i in odd else t or "" for i, t in enumerate(texts)], pa.large_string()), " ")
        ends = np.cumsum(split.value_lengths().to_numpy(), dtype=np.int64)
        flat, leads = split.flatten(), np.zeros(ends[-1] if len(ends) else 0, bool)
        leads[(ends - split.value_lengths().to_numpy())] = True
        found: list[str] = []
        numbers = np.empty(len(flat), np.int64)
        for at, space in ((leads, ""), (~leads, " ")):
            coded = flat.filter(pa.array(at)).dictionary_encode()
            numbers[at] = coded.indices.to_numpy() + len(found)
            found += [space + c for c in as_list(coded.dictionary)]
        if odd:
            known, parts = {c: i for i, c in enumerate(found)}, np.split(numbers, ends[:-1])
            for i, chunks in odd.items():
                parts[i] = np.array([known.setdefault(c, len(known)) for c in chunks], np.int64)
            found, numbers, ends = list(known), np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return found, numbers, ends

    def words(self, chunk: str) -> list[str]:
        if not chunk:
            return []
        if chunk in self.special:
            return [chunk]
        usual = _USUAL.fullmatch(chunk)
        if usual:
            return [w for w in usual.groups() if w]
        return self.find(chunk)


@functools.lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, chunks = splitter(path), defaultdict(int)

        def flush() -> pa.RecordBatch:
            words: dict[str, int] = defaultdict(int)
            for c, n in chunks.items():
                for w in cut.words(c):
                    words[w] += n
            chunks.clear()
            order = sorted(words)
            return pa.RecordBatch.from_arrays([pa.array(order, pa.string()), pa.array([words[w] for w in order], pa.int64())], names=["word", "n"])

        for b in in_batches(batches):
            found, numbers, _ = cut.numbered(b.column("text").to_pylist())
            for c, n in zip(found, np.bincount(numbers, minlength=len(found)).tolist()):
                chunks[c] += n
            if len(chunks) > 600_000:
                yield flush()
        yield flush()

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        cut, model, letters = splitter(path), WordModel(Tokenizer.from_file(path)), byte_letters()
        for b in batches:
            words, shown = as_list(b.column("word")), []
            for w in words:
                # Printable bytes but the space stand for themselves.
                plain = w.isascii() and w.isprintable()
                shown.append(w.replace(" ", letters[32]) if plain else "".join(map(letters.__getitem__, w.encode())))
            out = [np.array([cut.special[w]], "<u4").tobytes() if w in cut.special else ids for w, ids in zip(words, model.ids(shown))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=["word", "n", "ids"])

    return run


def word_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word, n, ids) of every distinct word, encoded once; written to the shared folder."""
    counted = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_count(path), "word string, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(_encode(path), "word string, n long, ids binary"), "words")


def pieces(spark, path: str) -> DataFrame:
    """(id, piece) with the bytes of each id; as long as the vocabulary."""
    cut, back = splitter(path), {c: b for b, c in byte_letters().items()}
    rows = [(i, bytes(back[c] for c in p)) for p, i in cut.vocab.items() if all(c in back for c in p)]
    known = {i for i, _ in rows}
    rows += [(i, t.encode()) for t, i in cut.special.items() if i not in known]
    special = {i: t.encode() for t, i in cut.special.items()}
    return spark.createDataFrame(pa.table({"id": [i for i, _ in rows], "piece": pa.array([special.get(i, p) for i, p in rows], pa.binary())}))


def decode(ids: DataFrame, path: str, key: str = "key") -> DataFrame:
    """(key, ids array) -> (key, decoded bytes): each id joins its piece, pieces return in place.

    Keys must be distinct; a null or empty array gives empty bytes.
    """
    table = pieces(ids.sparkSession, path)
    each = ids.select(key, F.posexplode("ids").alias("pos", "id")).join(table, "id")
    whole = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    whole = whole.select(key, F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["piece"])).alias("decoded"))
    return ids.select(key).join(whole, key, "left").select(key, F.coalesce("decoded", F.lit(b"")).alias("decoded"))


# --- the head of the table, packed ------------------------------------------
def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), "<u8", len(words))


def _pack_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ids) -> per batch a blob each of hashes, id counts, ids; sorted by hash."""
    for b in batches:
        h = _hashes([w.encode() for w in as_list(b.column("word"))])
        ids, order = as_list(b.column("ids")), np.argsort(h)
        flat = b"".join(ids[i] for i in order)
        n = np.array([len(ids[i]) // 4 for i in order], "<u4")
        yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in (("h", h[order].tobytes()), ("n", n.tobytes()), ("ids", flat))})


class Head:
    """The most frequent words' ids by hash, checked against the decoded bytes."""

    def __init__(self, blobs: list[tuple[bytes, bytes, bytes]], piece_bytes: list[bytes]):
        h = np.concatenate([np.frombuffer(b[0], "<u8") for b in blobs] or [np.zeros(0, "<u8")])
        n = np.concatenate([np.frombuffer(b[1], "<u4") for b in blobs] or [np.zeros(0, "<u4")]).astype(np.int64)
        self.ids = np.concatenate([np.frombuffer(b[2], "<u4") for b in blobs] or [np.zeros(0, "<u4")])
        order = np.argsort(h, kind="stable")
        self.hashes, self.n, self.at = h[order], n[order], (np.cumsum(n) - n)[order]
        # By id: the bytes, and the decimal number with a comma. A hole takes the empty last place.
        self.pieces = pa.array([*piece_bytes, b""], pa.large_binary())
        self.shown = pa.array([*(b"%d," % i for i in range(len(piece_bytes))), b""], pa.large_binary())

    def joined(self, table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The table's values of all ids in one run, and where each begins and the last ends."""
        return joined_values(table.take(pa.array(np.minimum(ids, len(table) - 1))))

    def find(self, words: list[str]) -> list[bytes | None]:
        """Each word's packed ids; None for a word that is not in the head."""
        coded = [w.encode() for w in words]
        out: list[bytes | None] = [None] * len(words)
        if not len(self.hashes):
            return out
        h = _hashes(coded)
        # In order of hash, which keeps the search to neighbouring places.
        order = np.argsort(h)
        at = np.empty(len(h), np.int64)
        at[order] = np.minimum(np.searchsorted(self.hashes, h[order]), len(self.hashes) - 1)
        ok = np.flatnonzero(self.hashes[at] == h)
        # The ids of all found words in one gather, then cut per word.
        n = self.n[at[ok]]
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(self.at[at[ok]] - (ends - n), n) + np.arange(n.sum())]
        decoded, places = self.joined(self.pieces, flat)
        raw, decoded = flat.tobytes(), decoded.tobytes()
        for i, a, b, x, y in zip(ok.tolist(), (ends - n).tolist(), ends.tolist(), places[ends - n].tolist(), places[ends].tolist()):
            if decoded[x:y] == coded[i]:
                out[i] = raw[4 * a : 4 * b]
        return out


def _digest(ids: list[int], decoded: bytes) -> tuple[int, str, str]:
    text = decoded.decode("utf-8", "replace").encode()
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest()


def _assemble(path: str, held, cache_limit: int = 100_000):
    """Documents -> their digests where every word is in the head; else packed ids with holes, and the holes' words.

    A hole is the id HOLE; its words are listed in order. The distinct chunks of
    a batch get their packed ids, which one gather each brings to the places of
    the chunks, to decimals and to decoded bytes. At most two times `cache_limit`
    chunks are kept, beside those of one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, hole = splitter(path), np.array([HOLE], "<u4").tobytes()
        head, caches = _cached_head(held)

        def learn(memo: dict, chunks: list[str]) -> None:
            split = [(c, cut.words(c)) for c in chunks]
            words = list(set().union(*[ws for _, ws in split]))
            got = dict(zip(words, head.find(words)))
            for c, ws in split:
                ids = [got[w] for w in ws]
                if None in ids:
                    memo[c] = b"".join([hole if x is None else x for x in ids]), [w for w, x in zip(ws, ids) if x is None]
                else:
                    memo[c] = ids[0] if len(ids) == 1 else b"".join(ids)

        for b in in_batches(batches, 1 << 20):
            found, numbers, ends = cut.numbered(b.column("text").to_pylist())
            new = [c for c in found if c not in caches[0]]
            if len(caches[0]) + len(new) > cache_limit:
                # The cache becomes the older generation; chunks met again come back from there.
                caches[:] = [{}, caches[0]]
                new = found
            memo, older = caches
            memo.update({c: older[c] for c in new if c in older})
            learn(memo, [c for c in new if c not in memo])
            packed = [memo[c] for c in found]
            # A chunk with holes is a pair of its ids and its holes' words.
            missing = {i: v[1] for i, v in enumerate(packed) if type(v) is tuple}
            packed = [v[0] if type(v) is tuple else v for v in packed] if missing else packed
            raw, places = joined_values(pa.array(packed, pa.large_binary()).take(pa.array(numbers)))
            ids = np.frombuffer(raw, "<u4", places[-1] // 4)
            shown, shown_at = head.joined(head.shown, ids)
            decoded, decoded_at = head.joined(head.pieces, ids)
            holed = np.isin(numbers, list(missing)) if missing else np.zeros(len(numbers), bool)
            cols: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "partial", "missing")}
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
                x, y = int(places[lo]) // 4, int(places[hi]) // 4
                lost = numbers[lo:hi][holed[lo:hi]].tolist() if missing else []
                if lost:
                    values = (None, None, None, ids[x:y].tobytes(), [w for i in lost for w in missing[i]])
                else:
                    text = str(decoded[decoded_at[x] : decoded_at[y]], "utf-8", "replace").encode()
                    # Without the last comma.
                    joined = shown[shown_at[x] : max(shown_at[x], shown_at[y] - 1)]
                    values = (y - x, hashlib.sha256(joined).hexdigest(), hashlib.sha256(text).hexdigest(), None, None)
                for k, v in zip(cols, values):
                    cols[k].append(v)
            kinds = {"n_tokens": pa.int64(), "partial": pa.binary(), "missing": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *[pa.array(v, kinds.get(k, pa.string())) for k, v in cols.items()]], names=["id", *cols]
            )

    return run


_HEADS: dict[str, tuple[Head, list[dict]]] = {}


def _cached_head(held) -> tuple[Head, list[dict]]:
    """The head of a broadcast (key, blobs, pieces) and two generations of cached chunks, kept for a Python worker's tasks."""
    key, blobs, piece_bytes = held.value
    if key not in _HEADS:
        _HEADS.clear()
        _HEADS[key] = Head(blobs, piece_bytes), [{}, {}]
    return _HEADS[key]


def _fill(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value[2]
        for b in batches:
            out: list[tuple] = []
            for partial, found in zip(b.column("partial").to_pylist(), b.column("found").to_pylist()):
                ids, filled = np.frombuffer(partial, "<u4").tolist(), iter(found)
                whole: list[int] = []
                for i in ids:
                    whole += np.frombuffer(next(filled), "<u4").tolist() if i == HOLE else [i]
                out.append(_digest(whole, b"".join(map(table.__getitem__, whole))))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


OUT = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, head: int = HEAD, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_tokens, and digests of the ids and of the decoded text.

    Null and empty texts have no ids. Special tokens inside a text are special.
    Repeated and null ids are encoded row by row; an empty table gives no rows;
    further columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("`text`").alias("text"))
    table = word_table(rows, path)
    # The lowest power of two of occurrences that at most `head` words reach.
    level = F.floor(F.log2("n")).cast("int").alias("level")
    sizes = sorted(((r["level"], r["count"]) for r in table.groupBy(level).count().collect()), reverse=True)
    least, taken = 64, 0
    for lv, n in sizes:
        if taken + n > head:
            break
        least, taken = lv, taken + n
    top = table.where((F.floor(F.log2("n")) >= least) & (F.octet_length("word") <= 64)).select("word", "ids")
    blobs = [tuple(r) for r in top.mapInArrow(_pack_head, "h binary, n binary, ids binary").collect()]
    piece_rows = pieces(spark, path).collect()
    by_id = [b""] * (max(r["id"] for r in piece_rows) + 1)
    for r in piece_rows:
        by_id[r["id"]] = bytes(r["piece"])
    held = spark.sparkContext.broadcast((os.urandom(8).hex(), [tuple(map(bytes, b)) for b in blobs], by_id))
    schema = OUT + ", partial binary, missing array<string>"
    done = rows.mapInArrow(_assemble(path, held), schema).withColumn("row", F.monotonically_increasing_id())
    done = stored(done, "encoded")
    holes = done.where("partial is not null").select("row", F.posexplode("missing").alias("pos", "word"))
    found = holes.join(table.select("word", "ids"), "word").groupBy("row")
    found = found.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"]).alias("found"))
    rest = done.where("partial is not null").select("id", "row", "partial").join(found, "row").select("id", "partial", "found")
    out = done.where("partial is null").select("id", "n_tokens", "ids_sha256", "decoded_sha256").union(rest.mapInArrow(_fill(held), OUT))
    return out.withColumnRenamed("id", id_col)
