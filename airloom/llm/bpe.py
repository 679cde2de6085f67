"""BPE encoding and decoding with content-defined chunks that documents share.

A rolling hash over the last 16 bytes cuts a text where its low bits are zero, so equal passages get equal chunks
wherever they stand. Chunks found in several documents are counted over the whole corpus; those that save the most, up to
``MAX_SHARED`` chunks of at most ``MAX_CHUNK`` bytes each (a dictionary of bounded size), are encoded once and
broadcast. Other chunks are encoded where they occur and reused within the task. Reuse never changes a result.

A cut may fall inside a word. A chunk's own tokens are those between its first and its last blank; what lies around a
cut is joined and encoded again, over more chunks until both ends of the joined part are blanks, where the
tokenizer always cuts; from there on both sides' tokens agree with the tokens of the whole text.

Encoding and decoding are those of the tokenizers library for vocabularies that drop white space and have no decoder
(tokens are joined by spaces). Null and empty texts have no tokens; very long texts are encoded whole. Rows are encoded one by one, so
repeated rows and null ids don't matter (documents without an id add nothing to the shared chunks); of chunks that save equally the one
that comes first by document and place is shared. Other columns are not read.
"""

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, table, written

#: A chunk ends on average every 2 ** CUT_BITS bytes.
CUT_BITS = 9
MAX_CHUNK = 2048
MAX_SHARED = 8192
#: Words and chunks that a worker keeps encoded (about 40 and 5 MB). Words are kept in two halves: when one is full, the older goes.
MAX_WORDS = 240_000
MAX_CHUNKS = 4_000
#: New words encoded by one call: short calls pay for the call, long ones for the offsets that the library keeps.
CALL_WORDS = 100
#: Chunks whose new words are gathered before they are encoded.
GROUP = 64
#: A special token of the vocabulary; no token of a text without "<|" is one.
PART = "<|endoftext|>"
BLANK = re.compile(rb"[\x20\x09\x0a\x0d]")
#: Letters, and ASCII signs after them: at least one word of the tokenizer, at least two with signs.
PLAIN = re.compile(r"([^\W\d_]+)[!-/:-@\[-`{-~]*")
HASH_BLOCK = 1 << 22


def tokenizer(vocabulary):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    found = Tokenizer.from_file(vocabulary)
    found.no_truncation()
    found.no_padding()
    return found


def cuts(raw):
    """Ends of the chunks of a byte string, the last one included."""
    ends = []
    for at in range(0, len(raw), HASH_BLOCK):
        h = np.frombuffer(raw, np.uint8, min(HASH_BLOCK + 15, len(raw) - max(0, at - 15)) if at else min(HASH_BLOCK, len(raw)), max(0, at - 15)).astype(np.uint32)
        h = (h + 1) * np.uint32(2654435761)
        for k, p in ((1, 2246822519), (2, 3266489917), (4, 668265263), (8, 374761393)):
            if len(h) > k:
                h[k:] = h[k:] + h[:-k] * np.uint32(p)
        skip = min(at, 15)
        ends.append(np.flatnonzero(h[skip:] >> np.uint32(32 - CUT_BITS) == 0) + at + 1)
    found = np.concatenate(ends).tolist() if ends else []
    if raw and (not found or found[-1] < len(raw)):
        found.append(len(raw))
    return found


def chunks(raw):
    """The chunks of a byte string in order; longer ones than ``MAX_CHUNK`` are cut there."""
    out, at = [], 0
    for end in cuts(raw):
        while end - at > MAX_CHUNK:
            out.append(raw[at : at + MAX_CHUNK])
            at += MAX_CHUNK
        if end > at:
            out.append(raw[at:end])
            at = end
    return out


@lru_cache(maxsize=2)
def loaded(vocabulary):
    """(tokenizer, ids as bytes, token of each id, whether each id ends a word, encoded words), kept by a Python worker from task to task."""
    found = tokenizer(vocabulary)
    ids = [str(i).encode() for i in range(found.get_vocab_size())]
    tokens = [found.id_to_token(i) or "" for i in range(len(ids))]
    suffix = found.model.end_of_word_suffix
    ends = [bool(suffix) and x.endswith(suffix) for x in tokens]
    return found, ids, {x: t.encode() for x, t in zip(ids, tokens)}, ends, [{}, {}]


class Coder:
    """Encodes texts chunk by chunk; an encoded part is its ids joined by spaces, as bytes."""

    def __init__(self, vocabulary, shared=None):
        self.tokenizer, self.ids, self.pieces, self.ends, self.words = loaded(vocabulary)
        self.known, self.shared = {}, shared or {}

    def ids_of(self, x):
        """The ids of a string; the fast call keeps no offsets."""
        return self.tokenizer.encode_batch_fast([x], add_special_tokens=False)[0].ids

    def keep(self, word, ids):
        self.words[0][word] = b" ".join([self.ids[i] for i in ids])

    def learn(self, words):
        """Encodes words that aren't kept yet, many at once: each ends at a blank, so each stands alone."""
        plain, other = [], []
        for w in words:
            x = w.decode("utf-8", "replace")
            if b"<|" in w:
                self.keep(w, self.ids_of(x))
            else:
                m = PLAIN.fullmatch(x)
                (plain if m else other).append((w, x, 1 + (m.end(1) < len(x)) if m else 0))
        for lo in range(0, len(plain), CALL_WORDS):
            self.learn_by_ends(plain[lo : lo + CALL_WORDS])
        for lo in range(0, len(other), CALL_WORDS):
            self.learn_parted(other[lo : lo + CALL_WORDS])

    def learn_by_ends(self, words):
        """Cuts the ids of words of known least numbers of ends; if there are more ends in all, some word has more of them."""
        ids = self.ids_of(" ".join([x for _, x, _ in words]))
        ends = [k for k, i in enumerate(ids, 1) if self.ends[i]]
        if len(ends) != sum(n for _, _, n in words):
            return self.learn_parted(words)
        known, ids, at, c = self.words[0], [self.ids[i] for i in ids], 0, -1
        for w, _, n in words:
            c += n
            known[w] = b" ".join(ids[at : ends[c]])
            at = ends[c]

    def learn_parted(self, words):
        """A special token parts any words."""
        end, at = self.tokenizer.token_to_id(PART), 0
        ids = self.ids_of(PART.join([x for _, x, _ in words])) + [end]
        for w, _, _ in words:
            to = ids.index(end, at)
            self.keep(w, ids[at:to])
            at = to + 1

    def prepare(self, words):
        """Keeps a set of words that the newer half has not."""
        known, old = self.words
        if len(known) + len(words) > MAX_WORDS // 2:
            self.words[:] = {}, known
            known, old = self.words
        again = words & old.keys()
        known.update((w, old[w]) for w in again)
        self.learn(words - again)

    def encode_words(self, lists):
        """The ids of each list of words, joined; new words of all lists are encoded together."""
        get = self.words[0].get
        found = [list(map(get, words)) for words in lists]
        gaps = [[k for k, x in enumerate(own) if x is None] for own in found]
        self.prepare({words[k] for words, own in zip(lists, gaps) for k in own})
        known = self.words[0]
        for words, own, at in zip(lists, found, gaps):
            for k in at:
                own[k] = known[words[k]]
        return [b" ".join(filter(None, own)) for own in found]

    def split(self, chunk):
        """(head, words, tail): the words lie between the chunk's first and last blank; without blanks all is head and words are None."""
        first = BLANK.search(chunk)
        if not first:
            return chunk, None, b""
        last = max(map(chunk.rfind, (b" ", b"\t", b"\n", b"\r")))
        return chunk[: first.start()], re.split(BLANK, chunk[first.end() : last]) if last > first.start() else [], chunk[last + 1 :]

    def chunk(self, chunk):
        """(head, encoded middle, tail)."""
        head, words, tail = self.split(chunk)
        if words is None:
            return head, None, tail
        return head, *self.encode_words([words]), tail

    def encode(self, text):
        """(ids joined by spaces, tokens joined by spaces, count) of a whole text, as bytes."""
        parts, join, pieces = [], b"", chunks((text or "").encode("utf-8", "replace"))
        for lo in range(0, len(pieces), GROUP):
            todo = []
            for piece in pieces[lo : lo + GROUP]:
                head, middle, tail = found = self.shared.get(piece) or self.known.get(piece) or self.split(piece)
                join += head
                if middle is None:
                    continue
                if join:
                    todo.append((len(parts), None, found, [join]))
                    parts.append(b"")
                if isinstance(middle, list):
                    todo.append((len(parts), piece, found, middle))
                    middle = b""
                parts.append(middle)
                join = tail
            for (at, piece, (head, _, tail), _), ids in zip(todo, self.encode_words([words for *_, words in todo])):
                parts[at] = ids
                if piece is not None:
                    if len(self.known) >= MAX_CHUNKS:
                        self.known.clear()
                    self.known[piece] = head, ids, tail
        if join:
            parts += self.encode_words([[join]])
        ids = b" ".join(filter(None, parts))
        each = ids.split()
        return ids, b" ".join(map(self.pieces.__getitem__, each)), len(each)


def shared_chunks(docs: DataFrame, max_shared: int = MAX_SHARED) -> DataFrame:
    """``(chunk)``: the chunks found in two or more documents that save the most bytes, each once."""
    session(docs)
    kinds = T.StructType([T.StructField(a, T.LongType()) for a in ("h", "n", "size", "doc_id", "at")])

    def found(batches):
        for batch in batches:
            seen = {}
            for doc, text in zip(batch["doc_id"], batch["text"]):
                own, at = set(), 0
                for c in chunks((text or "").encode("utf-8", "replace")):
                    h = xxhash.xxh3_64_intdigest(c)
                    if h not in own and len(c) > 16:
                        own.add(h)
                        seen.setdefault(h, [0, len(c), doc, at])[0] += 1
                    at += len(c)
            h = np.array(list(seen), np.uint64).view(np.int64)
            yield pd.DataFrame(dict(zip(kinds.names, (h, *np.array(list(seen.values()), np.int64).reshape(-1, 4).T))))

    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(found, kinds)
    counted = rows.groupBy("h").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "at", "size")).alias("one")).filter("n > 1")
    best = counted.select("one.*", ((F.col("n") - 1) * F.col("one.size")).alias("saved")).orderBy(F.desc("saved"), "doc_id", "at").limit(max_shared)
    places = F.broadcast(written(best))  # at most max_shared rows of four numbers
    raw = F.encode(docs["text"], "UTF-8")
    return docs.join(places, "doc_id").select(F.substring(raw, F.col("at").cast("int") + 1, F.col("size").cast("int")).alias("chunk")).distinct()


def dictionary(docs: DataFrame, vocabulary: str, max_shared: int = MAX_SHARED) -> dict:
    """``{chunk: (head, middle, tail)}``, encoded by the executors; at most ``max_shared`` chunks come to the driver."""
    kind = T.StructType([T.StructField(a, T.BinaryType()) for a in ("chunk", "head", "ids", "tail")])

    def encoded(batches):
        coder = Coder(vocabulary)
        for batch in batches:
            yield pd.DataFrame([(c, *coder.chunk(bytes(c))) for c in batch["chunk"]], columns=kind.names)

    rows = shared_chunks(docs, max_shared).limit(max_shared).mapInPandas(encoded, kind).collect()
    return {bytes(r.chunk): (bytes(r.head), None if r.ids is None else bytes(r.ids), bytes(r.tail)) for r in rows}


def _over(docs: DataFrame, vocabulary: str, kind: T.StructType, row, max_shared: int = MAX_SHARED) -> DataFrame:
    """``row(ids, tokens, n)`` for each document, by a coder with the corpus' shared chunks."""
    spark = session(docs)
    shared = spark.sparkContext.broadcast(dictionary(docs, vocabulary, max_shared))

    @F.pandas_udf(kind)
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Coder(vocabulary, shared.value)
        for texts in batches:
            yield pd.DataFrame([row(*coder.encode(x)) for x in texts], columns=kind.names)

    return docs.select("doc_id", coded("text").alias("c")).select("doc_id", "c.*")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _over(docs, vocabulary, kind, lambda ids, tokens, n: (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tokens).hexdigest()))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``: each document's token ids, and the text that they decode to."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return _over(docs, vocabulary, kind, lambda ids, tokens, n: (n, np.array(list(map(int, ids.split())), np.int32), tokens.decode()))


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the tokens of the ids joined by spaces."""
    session(encoded)

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = tokenizer(vocabulary)
        for x in batches:
            yield pd.Series([found.decode(list(i), skip_special_tokens=False) for i in x])

    return encoded.withColumn("decoded", text(ids))


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe_chunk_reuse(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), public_vocabulary())
