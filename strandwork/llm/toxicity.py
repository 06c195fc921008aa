"""Toxicity scores of texts that a noisy channel may have disguised."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm import fit
from strandwork.llm.common import forget, fraction, gathered, kept, slices, stored, texts_of

#: Labelled texts that the fit takes at most: those of the least hash.
SAMPLE = 20_000
#: Bytes of text that a Python worker reads at once.
READ_BYTES = 2 << 20
#: Tokens, and runs of them, whose words a worker keeps.
ENTRIES = 120_000
#: Smoothed log odds that a feature needs: four times as frequent in toxic texts as in clean ones.
LEAST_ODDS = math.log(4)
#: Symbols of the language model: 0 the edge of a word, 1 to 26 a to z, 27 any other letter.
SYMBOLS, OTHER = 28, 27

#: What each character of leetspeak may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Letters of other scripts that look like Latin ones.
ALIKE = dict(zip("авеікмнорсѕтухјһԁԛԝαβγεικνορτυχω", "abeikmhopcstyxjhdqwabyeikvoptuxw", strict=True))
#: Characters that are put between letters.
SEPARATORS = "._-*~'`^=:;,/\\#%&·​"
#: Log probabilities of the channel: a letter as it is, in leetspeak, repeated, and a separator put in.
AS_IS, SWAPPED, REPEATED, SEPARATED = 0.0, -1.5, -0.7, -0.5
#: A blank put into a word (between single characters it counts as a separator); what means itself: a digit beside a letter, one
#: that is not, another mark of LEET.
SPACED, DIGIT_IN_WORD, DIGIT, MARK = -3.0, -7.0, -4.0, -2.0
#: Letters of a piece that begins where a word may: more than the longest beginning that is a feature.
PIECE = 12

_EDGE = re.compile(r"^[^\w$@!|+€£¡]+|[^\w$@!|+€£¡]+$")
_RUN = re.compile(r"([^\w\s])\1\1+")
_THRICE = re.compile(r"(.)\1\1")
_TWICE = re.compile(r"(.)\1")
_ALIKE = re.compile(f"[{''.join(ALIKE)}]")
_LATIN = re.compile("[a-z]")
#: Some of the marks that _EDGE takes off.
PLAIN_MARKS = ".,;:?\"'()[]{}-"
_DISGUISED = re.compile("[0-9@$!|+(€£¡" + re.escape(SEPARATORS) + r"]|(.)\1\1")


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((points >= 97) & (points <= 122), points - 96, np.where((points > 127) & (points != 0xA0) & (points != 0x2019), OTHER, 0)).astype(np.int64)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """code and n: how often each run of three symbols occurs in all texts, words edged by symbol 0.

    Each task adds up its texts and hands on one row for each of the 28 ** 3 codes that it met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("letters")
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches, "text"):
            c = np.concatenate([np.append(_classes(t), (0, 0)) for t in [" ", *texts_of(batch)]])
            total += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text_col: str = "text") -> list[float]:
    """log P(c | a b) at code (a, b, c): trigrams of all texts smoothed by their bigrams and these by letters."""
    counts = np.zeros(SYMBOLS**3)
    for row in trigram_counts(docs, text_col).collect():
        counts[row["code"]] = row["n"]
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (three + 20 * p2) / (three.sum(2, keepdims=True) + 20)
    return np.log(p3).ravel().tolist()


def arcs(text: str, i: int) -> tuple[list[tuple[str, int, float]], float | None, float | None]:
    """What the lattice lets the character there be: letters (with symbol and cost), nothing and the edge of a word (cost, if it may)."""
    ch, before = text[i], text[i - 1 : i]
    options: list[tuple[str, int, float]] = []
    if ch in ALIKE:
        options += [(ALIKE[ch], _symbol(ALIKE[ch]), AS_IS), (ch, OTHER, SWAPPED)]
    elif ch.isalpha():
        options.append((ch, _symbol(ch), AS_IS))
    options += [(x, _symbol(x), SWAPPED) for x in LEET.get(ch, "")]
    skip = REPEATED if ch == before else None
    beside = before.isalpha() or text[i + 1 : i + 2].isalpha()
    edge = None if ch.isalpha() else (DIGIT_IN_WORD if beside else DIGIT) if ch.isdigit() else MARK
    if ch == " ":
        lone = text[max(0, i - 2) : i - 1] in ("", " ") and text[i + 2 : i + 3] in ("", " ")
        skip, edge = (SEPARATED, SEPARATED) if lone else (SPACED, 0.0)
    elif ch in SEPARATORS:
        skip = edge = SEPARATED
    elif not options:
        skip = edge = 0.0
    return options, skip, edge


def best_path(text: str, model: list[float]) -> tuple[float, str]:
    """Score and letters of the likeliest path: " " where it takes an edge, a line end where it drops a mark or blank."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i in range(len(text)):
        options, skip, edge = arcs(text, i)
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {s: (v + skip, out if options else (out, "\n")) for s, (v, out) in best.items()} if skip is not None else {}
        for (a, b), (v, out) in best.items():
            for x, c, cost in options:
                score = v + cost + model[(a * SYMBOLS + b) * SYMBOLS + c]
                if (b, c) not in new or new[b, c][0] < score:
                    new[b, c] = score, (out, x)
            if edge is not None:
                state, score = ((b, 0), v + edge + model[(a * SYMBOLS + b) * SYMBOLS]) if b else ((a, 0), v + edge)
                if state not in new or new[state][0] < score:
                    new[state] = score, (out, " ")
        best = new
    score, path = max(((v + model[(a * SYMBOLS + b) * SYMBOLS] if b else v, out) for (a, b), (v, out) in best.items()), key=lambda x: x[0])
    letters = []
    while path:
        path, x = path
        letters.append(x)
    return score, "".join(reversed(letters))


def decode(text: str, model: list[float]) -> tuple[list[str], list[str]]:
    """The likeliest words behind a run of disguised tokens, and their pieces from each place where an edge may be: Viterbi over its lattice.

    Position by position the lattice lets a character stand for itself, for a letter of LEET, for
    nothing (a repeated letter, a separator, a blank), or for the edge of a word (whatever is no letter). A path's score is the
    channel's plus that of the language model; a state is the last two symbols, and the best path to each is kept. Where
    the path drops a blank or a separator, the rest of the word is a piece: the model may have missed an edge there.
    """
    words, pieces = [], []
    for parts in (w.split("\n") for w in best_path(text, model)[1].split(" ")):
        word, at = "".join(parts), 0
        if word:
            words.append(word)
        for part in parts[:-1]:
            at += len(part)
            pieces.append(word[at : at + PIECE])
    return words, [x for x in pieces if len(x) > 2]


def restore(token: str, model: list[float]) -> str:
    """The likeliest words behind a disguised token, with blanks between them."""
    return " ".join(decode(token, model)[0])


def open_edges(model: list[float]) -> bytes:
    """1 at (last two symbols of a word, first two of the next) if a blank between them is likelier put in than an edge.

    The choice at a blank changes these trigrams only, so it is that of the lattice wherever words have two letters.
    """
    m = np.array(model).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    joined = m[:, :, :, None] + m[None, :, :, :] + SPACED
    apart = m[:, :, 0][:, :, None, None] + m[:, 0, :][None, :, :, None] + m[0][None, None, :, :]
    return (joined > apart).astype(np.uint8).tobytes()


def _symbol(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else OTHER


def _ends(head: str, tail: str, single: bool) -> int:
    """One number of the first two symbols of head and the last two of tail, each with 1 added and 0 where there are none, and of single."""
    lead = 1 + _symbol(head[0]) * SYMBOLS + (_symbol(head[1]) if len(head) > 1 else 0) if head else 0
    end = 1 + (_symbol(tail[-2]) if len(tail) > 1 else 0) * SYMBOLS + _symbol(tail[-1]) if tail else 0
    return (lead << 10 | end) << 1 | single


def undoubled(word: str, model: list[float]) -> str:
    """The word without each second of two equal letters that is likelier repeated than meant: what the lattice finds where letters come twice at most.

    The choice changes the trigrams of the letter, of that before and of that behind it.
    """
    out, done = [], 0
    for m in _TWICE.finditer(word):
        i = m.start()
        before, own = _symbol(word[i - 1]) if i else 0, _symbol(word[i])
        after = _symbol(word[i + 2]) if i + 2 < len(word) else 0
        head = (before * SYMBOLS + own) * SYMBOLS
        if REPEATED + model[head + after] > model[head + own] + model[(own * SYMBOLS + own) * SYMBOLS + after]:
            out.append(word[done : i + 1])
            done = i + 2
    return "".join([*out, word[done:]]) if out else word


def _token(token: str, model: list[float]) -> tuple[tuple[str, ...], str, int]:
    """A token's words, what is left of it without outer marks, and its _ends, where single means that one character is left."""
    bare = token.strip(PLAIN_MARKS)
    # letters of another script among Latin ones
    mixed = not bare.isascii() and _ALIKE.search(bare) is not None and _LATIN.search(bare) is not None
    if len(bare) > 1 and not mixed and bare.isalpha():
        if not _TWICE.search(bare):
            return (bare,), bare, _ends(bare, bare, False)
        if not _THRICE.search(bare):
            other = undoubled(bare, model)
            return (bare,) if other == bare else (bare, other), bare, _ends(bare, bare, False)
    bare = _EDGE.sub("", _RUN.sub("", token))
    plain = "".join(ch for ch in bare if ch.isalpha())
    words = [plain] if plain else []
    found = [plain]
    if mixed or _DISGUISED.search(bare):
        found, pieces = decode(bare, model)
        words += found + pieces
        found = found or [""]
    return tuple({w for w in words if w}), bare, _ends(found[0], found[-1], len(bare) == 1 and (bare.isalpha() or bare in LEET))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Reader:
    """Words of texts: each token as it stands without its marks, as restored if it may be disguised, and those of runs of tokens.

    A run goes on where two tokens are single characters or where a blank is likelier put in than the edge of a word; the
    lattice then decides on all of the run together. The texts of a batch are cut into tokens at once and every
    distinct token is read once; the memo stops to grow at `entries`, words are the same with or without it.
    """

    def __init__(self, model: list[float], entries: int = ENTRIES) -> None:
        self.model, self.edges, self.entries = model, np.frombuffer(open_edges(model), np.uint8).astype(bool), entries
        self.memo: dict[str, tuple] = {}

    def _held(self, key: str, read: Callable[[str, list[float]], tuple]) -> tuple:
        found = self.memo.get(key)
        if found is None:
            found = read(key, self.model)
            if len(self.memo) < self.entries and len(key) <= 64:
                self.memo[key] = found
        return found

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Numbers of a text and of a word for each pair of them, each pair once and in order, and the words."""
        lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        # marks behind a word are nothing to it: fewer distinct tokens without them
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(lowered, r"(\pL)[.,;:?]+(\s|$)", r"\1\2"))
        coded = lists.flatten().dictionary_encode()
        which = np.asarray(coded.indices)
        owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
        infos = [self._held(t, _token) for t in coded.dictionary.to_pylist()]
        numbers: dict[str, int] = {}
        size = np.fromiter((len(x[0]) for x in infos), np.int64, len(infos))
        words = np.array([numbers.setdefault(w, len(numbers)) for x in infos for w in x[0]], np.int64)
        n = size[which]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((np.cumsum(size) - size)[which] - ends + n, n)
        texts_, words_ = [np.repeat(owner, n)], [words[at]]
        if len(which) > 1:
            code = np.fromiter((x[2] for x in infos), np.int64, len(infos))[which]
            single, lead, tail = code & 1, code[1:] >> 11, code[:-1] >> 1 & 1023
            goes_on = (single[:-1] & single[1:] > 0) | (tail > 0) & (lead > 0) & self.edges[np.maximum(tail - 1, 0) * SYMBOLS**2 + np.maximum(lead - 1, 0)]
            goes_on &= owner[1:] == owner[:-1]
            turn = np.diff(np.concatenate([[False], goes_on, [False]]).astype(np.int8))
            for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True):
                run = [infos[k][1] for k in which[a : b + 1].tolist()]
                # where all are plain, the edges have decided
                found = ("".join(run),) if all(len(x) > 1 and x.isalpha() for x in run) else self._held(" ".join(run), _run)
                words_.append(np.array([numbers.setdefault(w, len(numbers)) for w in found], np.int64))
                texts_.append(np.full(len(found), owner[a]))
        pairs = _distinct(np.concatenate(texts_) * max(1, len(numbers)) + np.concatenate(words_))
        return pairs // max(1, len(numbers)), pairs % max(1, len(numbers)), [*numbers]


def _run(text: str, model: list[float]) -> tuple[str, ...]:
    return tuple(x for part in decode(text, model) for x in part)


def readings(text: str, model: list[float]) -> set[str]:
    """All words of one text."""
    return {*Reader(model).read(pa.array([text]))[2]}


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings of five and six letters: shorter ones begin too many other words."""
    return [f"={word}", *(word[:k] for k in range(5, min(7, len(word) + 1)))]


def _reader(model: list[float], entries: int) -> Reader:
    """One reader for each Python worker and language model."""
    return kept(("reader", hash(tuple(model)), entries), lambda: Reader(model, entries))


def shapes(n: int, owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of n texts, from its words' values: the two largest, and how many are large, also against all of them."""
    out = np.zeros((n, 4))
    some = values != 0
    order = np.lexsort((-values[some], owner[some]))
    mine, v = owner[some][order], values[some][order]
    first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
    out[mine[first], 0] = np.maximum(v[first], 0)
    second = first[(first + 1 < len(mine)) & (mine[np.minimum(first + 1, len(mine) - 1)] == mine[first])] + 1 if len(mine) else first
    out[mine[second], 1] = np.maximum(v[second], 0)
    large = np.log1p(np.bincount(owner[values > 2], minlength=n))
    out[:, 2], out[:, 3] = large, large / np.log(3 + np.bincount(owner, minlength=n))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, bytes_each: int = READ_BYTES, entries: int = ENTRIES) -> dict:
    """A model from labelled documents and a character language model of all of the corpus.

    Of the labelled texts (copies once, `sample` of them at most) those of both labels that hold a word or
    beginning are counted by grouped aggregation. The log odds of the features that at least three toxic texts hold, and LEAST_ODDS
    more often than clean ones, score a text's words, each text of the fit without its own share in the counts; a logistic regression
    on the two largest, and on how many are large, gives probabilities. Null labels are left out, null texts
    count as empty, repeated label rows once (the largest label); with one label only every score is that label's share.
    bytes_each and entries as in scored_rows: what is read at once, and what workers keep, changes no result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    n = marks.count()
    if n > sample:
        marks = marks.filter(fraction("doc_id", 7) < 2 * sample / n).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample)
    # at most `sample` labels go to all tasks, and as many texts come back
    chosen = stored(base.join(F.broadcast(marks), "doc_id").withColumn("key", F.xxhash64("text")), "labelled")
    # one row for each text: the others of a copy have a doc_id that is not the least of its key
    firsts = chosen.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    chosen = chosen.join(firsts.select("doc_id"), "doc_id", "left_semi").select("text", "label")
    model = language_model(base if corpus is None else corpus.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model, entries)
        for batch in gathered(batches, "text", bytes_each):
            toxic = (np.asarray(batch.column("label")) > 0).astype(np.int64)
            owner, word, words = reader.read(batch.column("text"))
            numbers: dict[str, int] = {}
            lists = [[numbers.setdefault(f, len(numbers)) for f in word_features(w)] for w in words]
            flat, size = np.array([x for fs in lists for x in fs], np.int64), np.fromiter(map(len, lists), np.int64, len(lists))
            n = size[word]
            at = np.arange(int(n.sum())) + np.repeat((np.cumsum(size) - size)[word] - np.cumsum(n) + n, n)
            # a text counts once for each of its features
            pairs = _distinct(np.repeat(owner, n) * max(1, len(numbers)) + flat[at])
            of, f = pairs // max(1, len(numbers)), pairs % max(1, len(numbers))
            held = np.bincount(f, minlength=len(numbers))
            bad = np.bincount(f[toxic[of] > 0], minlength=len(numbers))
            n_toxic = int(toxic.sum())
            yield pa.RecordBatch.from_arrays([pa.array(["", *numbers]), pa.array([len(toxic) - n_toxic, *(held - bad).tolist()], pa.int64()), pa.array([n_toxic, *bad.tolist()], pa.int64())], ["f", "clean", "toxic"])

    counts = chosen.mapInArrow(emit, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = stored(counts.filter("toxic >= 3 OR f = ''"), "features")
    whole = counts.filter("f = ''").first()
    n_clean, n_toxic = (whole["clean"], whole["toxic"]) if whole else (0, 0)
    if not n_clean or not n_toxic:
        return {"flat": float(n_toxic / max(1, n_clean + n_toxic)), "language": model}

    def odds(clean: int, toxic: int) -> float:
        return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))

    # of at most `sample` texts: what is common and clear in them is as bounded as they are
    clear = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) + math.log((n_clean + 1) / (n_toxic + 1))
    held = {r["f"]: (r["clean"], r["toxic"]) for r in counts.filter("f <> ''").filter(clear >= LEAST_ODDS).collect()}

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model, entries)
        for batch in gathered(batches, "text", bytes_each):
            own = (np.asarray(batch.column("label")) > 0).astype(np.int64)
            owner, word, words = reader.read(batch.column("text"))
            # a word's value without a clean text that holds it, and without a toxic one
            worth = np.array([[max((odds(max(0, held[f][0] - 1 + k), held[f][1] - k) for f in word_features(w) if f in held), default=0.0) for k in (0, 1)] for w in words]).reshape(-1, 2)
            x = shapes(len(own), owner, worth[word, own[owner]])
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(own, pa.int32())], ["x", "y"])

    found = chosen.mapInArrow(shape, "x array<double>, y int").toPandas()
    return {"language": model, "values": {f: odds(*v) for f, v in held.items()}, "weights": fit.logistic(np.stack(found["x"].to_numpy()), found["y"].to_numpy(np.float64))}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of every row by its whole restored text.

    Null texts count as empty, equal texts score alike, repeated rows stay.
    """
    return scored_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), model).drop("text")


def scored_rows(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score", bytes_each: int = READ_BYTES, entries: int = ENTRIES) -> DataFrame:
    """The rows with a score column; one of that name is replaced. Texts of some bytes_each are read together, a worker keeps `entries` tokens."""
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    names = [*docs.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = model.get("values", {})
        reader, worth = _reader(model["language"], entries), {}
        for batch in gathered(batches, text_col, bytes_each):
            if values:
                owner, word, words = reader.read(batch.column(text_col))
                found = []
                for w in words:
                    v = worth.get(w)
                    if v is None:
                        v = max((values[f] for f in word_features(w) if f in values), default=0.0)
                        if len(worth) < entries:
                            worth[w] = v
                    found.append(v)
                x = shapes(batch.num_rows, owner, np.array(found, np.float64)[word])
                scores = fit.sigmoid(np.column_stack([x, np.ones(len(x))]) @ model["weights"])
            else:
                scores = np.full(batch.num_rows, model["flat"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(scores, 9))], names)

    return docs.mapInArrow(run, schema)
