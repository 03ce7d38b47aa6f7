"""SentencePiece encoding and decoding over a relational lattice.

Every substring of a word of at most the longest piece's length is equi-joined to the piece table; the matches are the edges of the word's lattice,
are grouped by word, and folded. The words of the lexicon, which are the commonest of the corpus (at most ``lexicon_words``, of at most ``LONGEST``
characters), are encoded once: their substrings are exploded and joined by Spark, and folded by its higher-order ``aggregate``:

* unigram models: Viterbi, the best score to each position, then the way back;
* byte-pair models: best merge first, the edge of highest score (leftmost on ties) whose two halves are both symbols now.
  The public model at hand is of this kind. Its scores are merge ranks, and the sum that Viterbi maximises is not what defines
  its encoding, so only this fold gives the ids of the library.

Words are cut at blanks, at line ends, and between characters of different groups, where characters that stand side by side in a piece are of
one group; no piece reaches over these cuts, so a text's ids are its words' ids in order. Texts are encoded whole, in place, by looking words up
in the lexicon, which is broadcast as its size is bounded. Every other word of a text goes through the same lattice where the text is, for many
words at once: its substrings are joined to the broadcast piece table (a constant of the model) size by size, and the edges are folded. This join probes sorted keys in NumPy, in
the task, as rows of exploded substrings through the JVM took most of the query's time. So the bound tells only where a word is joined and folded, the model's library
encodes nothing, and no text and no word occurrence is shuffled, only counts of distinct words. Characters without a piece become their bytes' pieces.

Results for odd input: a null text has null ids and 0 tokens, an empty one no ids; ids decode to the same text, except that the
blank symbol U+2581 of the model reads as a blank; equal rows get equal results; an empty table gives no rows; further columns
are ignored by :func:`encoded` except those asked for; texts are used whole.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import durable, free_name, text_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
LONGEST = 48
#: Words of more characters are folded by a heap.
PART = 256


@dataclass(frozen=True)
class Pieces:
    """rows: (piece, id, score) of the ordinary pieces; first_byte: id of <0x00>; kind: 'bpe' or 'unigram'."""

    rows: list[tuple[str, int, float]]
    first_byte: int
    kind: str
    proto: bytes | None = None

    @staticmethod
    def from_model(path: str = MODEL) -> Pieces:
        import sentencepiece

        with open(path, "rb") as f:  # on the driver; executors get the content
            proto = f.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = range(sp.get_piece_size())
        rows = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in n if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        whole = sp.encode("aa bb", out_type=int)  # byte-pair scores are ranks: whole numbers
        kind = "bpe" if whole and all(s == int(s) for _, _, s in rows[:500]) else "unigram"
        return Pieces(rows, next(i for i in n if sp.is_byte(i)), kind, proto)

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)

    @property
    def unknown(self) -> float:
        """The score at which Viterbi passes a character without a piece."""
        return min(s for _, _, s in self.rows) - 10.0

    def words(self) -> str:
        """Pattern of the words of a text: blanks and the characters of one group after them. Those side by side in a piece are of one group."""
        group: dict[str, str] = {}

        def find(c: str) -> str:
            while group.setdefault(c, c) != c:
                group[c] = c = group[group[c]]
            return c

        for p, _, _ in self.rows:
            for a, b in zip(p, p[1:], strict=False):
                if not {a, b} & {BLANK, " ", "\n"}:
                    group[find(a)] = find(b)
        groups: dict[str, str] = {}
        for c in sorted(group):
            groups[find(c)] = groups.get(find(c), "") + c
        several = [re.escape(g) for g in sorted(groups.values(), key=len, reverse=True)]
        return "|".join([*(f" *[{g}]+" for g in several), f" *[^ \n{''.join(several)}]", " +", "\n"])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "piece string, id int, score double")


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def merge_fold(size: Column, edges: Column) -> Column:
    """Ends of the final symbols: starts from single characters and merges along edges, best score first."""
    kind = "struct<cuts:array<int>,live:array<struct<s:int,e:int,score:double,id:int>>>"

    def merge(state: Column, _: Column) -> Column:
        ready = F.filter(state["live"], lambda x: F.array_position(state["cuts"], x["e"]) - F.array_position(state["cuts"], x["s"]) == 2)
        best = F.array_max(F.transform(ready, lambda x: F.struct(x["score"].alias("score"), (-x["s"]).alias("left"), x["s"].alias("s"), x["e"].alias("e"))))
        return _bind(best, lambda b: F.when(b.isNull(), F.struct(state["cuts"].alias("cuts"), F.filter(state["live"], lambda x: F.lit(False)).alias("live"))).otherwise(
            _bind(F.filter(state["cuts"], lambda c: (c <= b["s"]) | (c >= b["e"])), lambda cuts: F.struct(cuts.alias("cuts"), F.filter(state["live"], lambda x: F.array_contains(cuts, x["s"]) & F.array_contains(cuts, x["e"]) & ((x["s"] != b["s"]) | (x["e"] != b["e"]))).alias("live")))))

    start = F.struct(F.sequence(F.lit(0), size).alias("cuts"), F.filter(edges, lambda x: x["e"] - x["s"] > 1).alias("live")).cast(kind)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), start, lambda a, x: merge(a, x).cast(kind), lambda a: a["cuts"])


def viterbi_fold(size: Column, edges: Column, unknown: float) -> Column:
    """Ends of the symbols of the best path; a character without an edge may be passed at the score ``unknown``."""
    kind = "array<struct<score:double,s:int>>"

    def reach(best: Column, e: Column) -> Column:
        ways = F.transform(F.filter(edges, lambda x: x["e"] == e), lambda x: F.struct((best[x["s"]]["score"] + x["score"]).alias("score"), x["s"].alias("s")))
        alone = F.array(F.struct((best[e - 1]["score"] + F.lit(unknown)).alias("score"), (e - 1).alias("s")))
        single = F.exists(edges, lambda x: (x["e"] == e) & (x["s"] == e - 1))
        return F.concat(best, F.array(F.array_max(F.when(single, ways).otherwise(F.concat(ways, alone))))).cast(kind)

    best = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"))).cast(kind), reach)
    back = lambda b: F.aggregate(F.sequence(F.lit(1), size), F.array(size), lambda cuts, _: F.when(cuts[0] > 0, F.concat(F.array(b[cuts[0]]["s"]), cuts)).otherwise(cuts))
    return _bind(best, back)


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of distinct words: explode substrings, join the piece table, group edges by word, fold."""
    spark = words.sparkSession
    longest = pieces.longest
    shown = F.replace("word", F.lit(" "), F.lit(BLANK))
    grid = words.select("word", shown.alias("shown"), F.char_length("word").alias("size")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    grid = grid.withColumn("e", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("size"), F.col("s") + longest))))
    parts = grid.withColumn("piece", F.col("shown").substr(F.col("s") + 1, F.col("e") - F.col("s")))
    edges = parts.join(F.broadcast(pieces.frame(spark)), "piece", "left").filter("id is not null or (s = 0 and e = 1)")
    lattice = edges.groupBy("word", "shown", "size").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("s", "e", "score", "id"))).alias("edges"))
    size, of = F.col("size"), F.col("edges")
    cuts = merge_fold(size, of) if pieces.kind == "bpe" else viterbi_fold(size, of, pieces.unknown)

    def ids(cuts: Column) -> Column:
        def of_symbol(i: Column) -> Column:
            s, e = cuts[i - 1], cuts[i]
            hit = F.filter(of, lambda x: (x["s"] == s) & (x["e"] == e))
            code = F.hex(F.encode(F.col("shown").substr(s + 1, e - s), "UTF-8"))
            as_bytes = F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: (F.conv(code.substr(k, F.lit(2)), 16, 10).cast("int") + pieces.first_byte))
            return F.when(F.size(hit) > 0, F.transform(hit, lambda x: x["id"])).otherwise(as_bytes)

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), of_symbol))

    return lattice.withColumn("cuts", cuts).select("word", ids(F.col("cuts")).alias("ids"))


def count_words(docs: DataFrame, pieces: Pieces, text_col: str = "text", flush: int = 200_000) -> DataFrame:
    """(word, n) of all texts."""
    pattern = pieces.words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        words = re.compile(pattern)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(words.findall(" " + t.replace(BLANK, " ")))
                if len(seen) > flush:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return text_batches(docs).select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, pieces: Pieces, lexicon_words: int = 1 << 17, text_col: str = "text") -> DataFrame:
    """(word, ids) of the words that are common enough for at most ``lexicon_words`` to be; :func:`encoded` takes all others through the lattice in place."""
    counts = durable(count_words(docs, pieces, text_col).filter((F.col("n") > 1) & (F.char_length("word") <= LONGEST)))
    step = F.floor(F.log2("n") * 32)
    total, least = 0, None
    for bin_, n in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += n
        if total > lexicon_words:
            break
        least = bin_
    chosen = counts.filter(step >= least) if least is not None else counts.limit(0)
    return encode_words(chosen.select("word").repartition(64, "word"), pieces)


def piece_levels(pieces: Pieces) -> tuple[np.ndarray, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The piece table as :func:`lattice` joins it, a level for each size: (number of each character, their count, ids of single characters, [(keys, ids)] of sizes 2, 3, ...).

    A key is the place, in the level before, of all characters but the last, times the count, plus the last one's number; keys ascend. Beginnings of pieces that are no pieces have id -1,
    and so have characters without a piece.
    """
    known = {p: i for p, i, _ in pieces.rows}
    begins = {p[:k] for p in known for k in range(1, len(p) + 1)}
    chars = sorted({c for p in known for c in p})
    alphabet = len(chars) + 1  # the last number is that of all other characters
    number = np.full(0x110000, len(chars), np.uint16 if alphabet < 1 << 16 else np.int32)
    number[[ord(c) for c in chars]] = np.arange(len(chars))
    place = {c: i for i, c in enumerate(chars)}
    single = np.array([*(known.get(c, -1) for c in chars), -1], np.int32)
    levels, before = [], place
    for size in range(2, pieces.longest + 1):
        keyed = sorted((before[p[:-1]] * alphabet + place[p[-1]], p) for p in begins if len(p) == size)
        before = {p: i for i, (_, p) in enumerate(keyed)}
        levels.append((np.array([key for key, _ in keyed], np.int64), np.array([known.get(p, -1) for _, p in keyed], np.int32)))
    return number, alphabet, single, levels


def lattice(words: list[str], table: tuple[np.ndarray, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters of each word, first character, size, id) of the edges of all words' lattices; characters are counted through all words, and the edges of single characters come first, in order.

    Substrings meet the piece table by size: those of a size are joined, as (place of their beginning, last character), to the level's keys; one whose beginning is no piece's is not looked up.
    Ids below 0: -1 less the code point of a character without a piece.
    """
    number, alphabet, single, levels = table
    chars = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).replace(" ", BLANK).encode("utf-32-le"), np.uint32)
    last = number[codes]
    ends = np.repeat(np.cumsum(chars), chars)  # of each character's word
    ids = single[last]
    edges = [(np.arange(len(codes)), 1, np.where(ids < 0, -1 - codes.astype(np.int32), ids))]
    begin, place = edges[0][0], last.astype(np.int64)
    for size, (keys, of) in enumerate(levels, 2):
        inside = np.flatnonzero(begin + size <= ends[begin])
        begin = begin[inside]
        if not (len(begin) and len(keys)):
            break
        key = place[inside] * alphabet + last[begin + size - 1]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = np.flatnonzero(keys[place] == key)
        begin, place = begin[hit], place[hit]
        ids = of[place]
        whole = np.flatnonzero(ids >= 0)
        edges.append((begin[whole], size, ids[whole]))
    begins, sizes, ids = zip(*edges, strict=True)
    return chars, np.concatenate(begins), np.repeat(np.array(sizes), [len(x) for x in begins]), np.concatenate(ids)


def fold_words(chars: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray, rank: np.ndarray, score: np.ndarray, pieces: tuple[str, int, float]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of each) from their lattices. ``rank`` and ``score`` of each id: ranks are 0 for the best score.

    ``pieces``: kind, id of <0x00>, score of a character without a piece.
    """
    kind, first_byte, unknown = pieces
    many, heads = len(chars), int(chars.sum())
    start = np.cumsum(chars) - chars + np.arange(many)  # each word has a slot for each character, and one for its end
    word = np.repeat(np.arange(many), chars)[begin]
    dead = heads + many
    to = np.arange(1, dead + 2, dtype=np.int32)  # end of the symbol that begins here
    to[start + chars] = to[dead] = dead
    begin = begin + word
    symbol = np.zeros(dead + 1, np.int32)
    symbol[begin[:heads]] = ids[:heads]
    if kind == "bpe":
        word, begin, size, ids = word[heads:], begin[heads:], size[heads:], ids[heads:]
        order = _order(word, rank[ids], begin)
        word, begin, end, ids = word[order], begin[order].astype(np.int32), (begin + size)[order].astype(np.int32), ids[order]
        long = np.flatnonzero(chars > PART)
        short = np.flatnonzero(chars[word] <= PART) if len(long) else slice(None)
        _merge(word[short], begin[short], end[short], ids[short], to, symbol, many)
        for first, upto in zip(np.searchsorted(word, long), np.searchsorted(word, long, "right"), strict=True):
            _merge_long(begin[first:upto], end[first:upto], ids[first:upto], score[ids[first:upto]], to, symbol)
    else:
        order = np.lexsort((size, begin))
        word, begin, size, ids = word[order], begin[order], size[order], ids[order]
        edges = np.split(np.arange(len(word)), np.flatnonzero(np.diff(word)) + 1)
        for mine, at, n in zip(edges, start.tolist(), chars.tolist(), strict=True):
            _best_path((begin[mine] - at).tolist(), size[mine].tolist(), ids[mine].tolist(), np.where(ids[mine] < 0, unknown, score[np.maximum(ids[mine], 0)]).tolist(), at, n, to, symbol, dead)
    begins = np.flatnonzero(to != dead)
    got, number = symbol[begins], np.searchsorted(start, begins, "right") - 1
    plain = np.flatnonzero(got < 0)
    if len(plain):
        codes = [chr(-1 - x).encode() for x in got[plain].tolist()]
        times = np.ones(len(got), np.int64)
        times[plain] = [len(c) for c in codes]
        got, number, bare = (np.repeat(x, times) for x in (got, number, got < 0))
        got[bare] = np.frombuffer(b"".join(codes), np.uint8).astype(np.int32) + first_byte
    return got, np.bincount(number, minlength=many)


def _order(word: np.ndarray, rank: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Order by word, rank and begin: by one number where all three fit into it."""
    if not len(word):
        return np.zeros(0, np.int64)
    bits = [int(x.max()).bit_length() for x in (word, rank, begin)]
    if sum(bits) > 63:
        return np.lexsort((begin, rank, word))
    return np.argsort(word << (bits[1] + bits[2]) | rank.astype(np.int64) << bits[2] | begin)


def _merge(word: np.ndarray, begin: np.ndarray, end: np.ndarray, ids: np.ndarray, to: np.ndarray, symbol: np.ndarray, many: int) -> None:
    """One merge of each word at a time: the first of its edges, best first, whose two halves are symbols."""
    dead, live = len(to) - 1, np.ones(len(to), bool)
    while len(word):
        ready = np.flatnonzero(to[to[begin]] == end)
        of = word[ready]
        best = ready[np.flatnonzero(np.diff(of, prepend=-1))]
        middle = to[begin[best]]
        to[begin[best]], symbol[begin[best]], to[middle], live[middle] = end[best], ids[best], dead, False
        on = np.zeros(many, bool)
        on[of] = True
        on = on[word] & live[begin] & live[end]
        on[best] = False
        word, begin, end, ids = word[on], begin[on], end[on], ids[on]


def _merge_long(begin: np.ndarray, end: np.ndarray, ids: np.ndarray, score: np.ndarray, to: np.ndarray, symbol: np.ndarray) -> None:
    """The same for one long word, by a heap of the edges whose halves are symbols."""
    dead = len(to) - 1
    edges = {(b, e): (-x, b, e, i) for b, e, x, i in zip(begin.tolist(), end.tolist(), score.tolist(), ids.tolist(), strict=True)}
    heap = [x for (b, e), x in edges.items() if e - b == 2]
    heapq.heapify(heap)
    back: dict[int, int] = {}  # begin of the symbol that ends here, where it was merged
    while heap:
        _, b, e, i = heapq.heappop(heap)
        middle = int(to[b])
        if middle == dead or to[middle] != e:
            continue
        to[b], symbol[b], to[middle], back[e] = e, i, dead, b
        for x in (edges.get((b, int(to[e]))), edges.get((back.get(b, b - 1), e))):
            if x:
                heapq.heappush(heap, x)


def _best_path(s: list[int], size: list[int], ids: list[int], score: list[float], at: int, n: int, to: np.ndarray, symbol: np.ndarray, dead: int) -> None:
    """Viterbi over one word, whose slots begin at ``at``: edges come by first character, whose best score is known by then."""
    best: list = [(0.0, 0, -1), *[None] * n]
    for b, k, i, x in zip(s, size, ids, score, strict=True):
        way = (best[b][0] + x, b, i)
        if best[b + k] is None or way > best[b + k]:
            best[b + k] = way
    to[at : at + n] = dead
    while n:
        _, b, i = best[n]
        to[at + b], symbol[at + b], n = at + n, i, b


def encoded(docs: DataFrame, pieces: Pieces | None = None, lexicon_words: int = 1 << 17, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), most_edges: int = 1 << 18, held: int = 1 << 17) -> DataFrame:
    """The columns ``keep`` with n_tokens, ids, and round_trip: whether the decoded ids are the text.

    Words beyond the lexicon are folded together up to ``most_edges`` / 4 characters (a longer one alone); a task forgets their ids when it has more than ``held``.
    """
    pieces = pieces or Pieces.from_model()
    known = lexicon(docs, pieces, lexicon_words, text_col).toArrow()
    known_ids = known["ids"].combine_chunks() if known.num_rows else pa.array([], pa.list_(pa.int32()))
    flat = known_ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    lengths = known_ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    score = np.zeros(max(i for _, i, _ in pieces.rows) + 1)
    for _, i, x in pieces.rows:
        score[i] = x
    rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((known["word"].to_pylist(), flat, lengths, score, rank, piece_levels(pieces), _piece_bytes(pieces)))
    model, pattern, width = (pieces.kind, pieces.first_byte, pieces.unknown), pieces.words(), len(keep)
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "ids" not in cache:
            words_, ids_, sizes_, score_, rank_, levels_, bytes_ = shared.value
            size = max(bytes_) + 1
            cache.update(words=words_, ids=ids_, sizes=sizes_, score=score_, rank=rank_, levels=levels_)
            cache.update(shown=np.frombuffer(b"".join(bytes_.get(i, b"") for i in range(size)), np.uint8), starts=np.concatenate([[0], np.cumsum([len(bytes_.get(i, b"")) for i in range(size)])]))
        shown, starts, find = cache["shown"], cache["starts"], re.compile(pattern).findall
        n_known = len(cache["words"])
        number: defaultdict[str, int] = defaultdict(count(n_known).__next__, zip(cache["words"], range(n_known), strict=True))  # a new word gets the next number
        ids, sizes = cache["ids"], cache["sizes"]  # of the lexicon's words, and of this task's after them

        def fold(new: list[str]) -> None:
            """Ids of words that have none yet."""
            nonlocal ids, sizes
            ends, at, got = np.cumsum([len(w) for w in new]), 0, [(ids, sizes)]
            while at < len(new):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_edges // 4, "right")))
                got.append(fold_words(*lattice(new[at:upto], cache["levels"]), cache["rank"], cache["score"], model))
                at = upto
            ids, sizes = (np.concatenate(x) for x in zip(*got, strict=True))

        def encode(b: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
            found = [find(" " + t.replace(BLANK, " ")) if t else () for t in texts]
            words_ = np.array([len(x) for x in found], np.int64)
            k = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int32, int(words_.sum()))
            if len(number) > len(sizes):
                fold(list(islice(reversed(number), len(number) - len(sizes)))[::-1])
            full = np.flatnonzero(words_)
            n, ok, values = np.zeros(len(texts), np.int64), np.array([t == "" for t in texts]), np.zeros(0, np.int32)
            if len(full):
                lengths_ = sizes[k]
                values = _ranges(ids, (np.cumsum(sizes) - sizes)[k], lengths_)
                n[full] = np.add.reduceat(lengths_, np.concatenate([[0], np.cumsum(words_[full])[:-1]]))
                spans = starts[values + 1] - starts[values]
                plain = _ranges(shown, starts[values], spans).tobytes()
                ends = np.cumsum(np.add.reduceat(spans, np.concatenate([[0], np.cumsum(n[full])[:-1]])))
                for i, s, e in zip(full.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    ok[i] = plain[s + 1 : e] == texts[i].encode()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values, pa.int32()), mask=pa.array([x is None for x in texts]))
            return pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(n, pa.int32()), lists, pa.array(ok)], names=[*keep, "n_tokens", "ids", "round_trip"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                first, size, texts = at, 0, []
                while at < b.num_rows and size < 1 << 18:  # a text is whole
                    texts.append(b.column(width)[at].as_py())
                    size += len(texts[-1] or "")
                    at += 1
                if len(number) > n_known + held:
                    for w in list(islice(reversed(number), len(number) - n_known)):
                        del number[w]
                    number.default_factory, ids, sizes = count(n_known).__next__, cache["ids"], cache["sizes"]
                yield encode(b.slice(first, at - first), texts)

    types = dict(docs.dtypes)
    rows = text_batches(docs).select(*keep, F.col(text_col).alias(free_name(list(keep), "_text")))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens int, ids array<int>, round_trip boolean")


def _ranges(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]], one after the other."""
    ends = np.cumsum(lengths)
    return values[np.minimum(np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0), len(values) - 1)]


def _piece_bytes(pieces: Pieces) -> dict[int, bytes]:
    return {i: p.replace(BLANK, " ").encode() for p, i, _ in pieces.rows} | {pieces.first_byte + i: bytes([i]) for i in range(256)}


def decoded(ids: DataFrame, pieces: Pieces | None = None, ids_col: str = "ids") -> DataFrame:
    """``ids`` with the column text."""
    table = _piece_bytes(pieces or Pieces.from_model())
    names = ids.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if x is None else b"".join(table.get(i, b"") for i in x)[1:].decode("utf-8", "replace") for x in b.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*names, "text"])

    return text_batches(ids).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in ids.dtypes) + ", text string")
