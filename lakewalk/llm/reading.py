"""Reading level of documents: sentence-level models, aggregated and calibrated.

A regularised linear model over words, the character n-grams in them and the sentence's length gives every sentence a
distribution over the grades (and over languages). The distributions of a document's main text are averaged, and logistic models, fitted on
labelled documents that the sentence model hadn't seen, turn the averages into the document's level.

Main text is found line by line: navigation, copyright lines, readers' comments, headlines and rows of lists by their
form; notices because they recur, in a share of the whole corpus, in documents that otherwise differ. The same lines are
fitted on and scored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import warnings
import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewalk.storage import written

GRADES = 5
LANGUAGES = ("de", "en", "es", "fr")
#: Hashed features of the sentence model.
DIMENSIONS = 2**16
#: At most this many labelled documents are fitted on, those with the lowest hashes of doc_id, and of these only such whose
#: main text has at most so many characters. Both bound what comes to the driver.
LABELLED, LABELLED_CHARS = 4000, 50_000
#: A line is a notice if it occurs in different contexts (documents with different longest other lines) that are at least
#: this share of all documents, and at least so many.
CONTEXT_SHARE, CONTEXTS = 0.005, 12
#: Sentence lengths are a feature in so many classes, four to a doubling.
LENGTHS = 36
#: L2 penalties of the sentence model and of the calibration.
PENALTY, CALIBRATION_PENALTY = 1e-5, 1e-2
#: The sentence model is fitted until the gradient's norm is this share of that at zero weights. That takes some hundred
#: steps; the bound on them only guards against a fit that can't end, which is reported.
TOLERANCE, MOST_STEPS = 2e-3, 3000
#: A worker forgets its words beyond this number.
MOST_WORDS = 500_000

WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
SENTENCE_END = re.compile(r"(?<=[.!?;…])\s+")
LINE_END = re.compile(r"\r\n|\n|\r")
SEPARATOR = re.compile(r"\s[|·»•\ufffd]\s")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
#: A line that begins with the name of an account: one word with digits, underscores or an @, and a colon.
COMMENT = re.compile(r"(?=\S*[\d_@])[\w@.+-]+:\s")
#: A first line that names something and says what it is.
HEADLINE = re.compile(r"[^:]{1,40}:")
MOJIBAKE = re.compile("[\xc2-\xf4][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")

_SINGLE = {
    **{chr(i): bytes([i]) for i in range(256)},
    **{bytes([i]).decode("cp1252"): bytes([i]) for i in range(128, 160) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)},
}


def repair(text: str) -> str:
    """Undo UTF-8 that was read as cp1252 or Latin-1, line by line, where a line can be undone."""
    if not MOJIBAKE.search(text):
        return text
    lines = []
    for line in text.split("\n"):
        try:
            lines.append(b"".join(_SINGLE[c] for c in line).decode() if MOJIBAKE.search(line) else line)
        except (KeyError, UnicodeDecodeError):
            lines.append(line)
    return "\n".join(lines)


def unwrapped(lines: Sequence[str]) -> list[str]:
    """Lines of hard-wrapped text joined again. A text counts as wrapped if many lines go on in lower case; then every
    line without a sentence's end is joined to the next, and a hyphen at its end dropped."""
    goes_on = [len(a) > 30 and a[-1] not in ".!?;…:" and bool(b) and b[0].islower() for a, b in zip(lines, lines[1:])]
    if not any(goes_on) or 4 * sum(goes_on) < sum(len(x) > 30 for x in lines):
        return list(lines)
    joined: list[str] = []
    width = max(map(len, lines))
    for i, line in enumerate(lines):
        before = lines[i - 1] if i else ""
        if joined and (
            goes_on[i - 1] or (
                2 * len(before) > width and before[-1] not in ".!?;…:" and not SEPARATOR.search(line) and "©" not in line
            )
        ):
            joined[-1] = joined[-1][:-1] + line if joined[-1].endswith("-") else f"{joined[-1]} {line}"
        else:
            joined.append(line)
    return joined


def main_lines(text: str | None) -> list[str]:
    """The lines that may be running text by their form. Null and empty texts have none."""
    kept = []
    text = unicodedata.normalize("NFKC", INVISIBLE.sub("", repair(text or "")))
    for line in unwrapped([x.strip() for x in LINE_END.split(text)]):
        words = len(WORD.findall(line))
        if words <= 3 or words > 3 * len(line.split()) or "©" in line or line[0] == "\ufffd" or COMMENT.match(line):
            continue
        parts = SEPARATOR.split(line)
        if len(parts) > 1 and words <= 3 * len(parts):
            continue
        if not kept and words <= 20 and line[-1] not in ".!?;…" and HEADLINE.match(line):
            continue
        kept.append(line)
    return kept


def line_hash(line: str) -> int:
    """Alike for lines that differ in digits and letter case only."""
    return xxhash.xxh64_intdigest(re.sub(r"\d+", "#", line.lower())) - 2**63


def contexts(hashes: Sequence[int], lines: Sequence[str]) -> list[int]:
    """For each line the hash of the document's longest other line (of another hash); 0 if there is none."""
    order = sorted(range(len(lines)), key=lambda i: (-len(lines[i]), hashes[i]))
    found = []
    for h in hashes:
        found.append(next((hashes[i] for i in order if hashes[i] != h), 0))
    return found


def least_contexts(documents: int) -> int:
    """In how many contexts a line has to occur to be a notice, in a corpus of so many documents."""
    return max(CONTEXTS, math.ceil(CONTEXT_SHARE * documents))


def features(word: str) -> list[int]:
    """The word itself and its character n-grams of 3 to 5, hashed."""
    marked = f"<{word}>"
    grams = [marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))]
    return [zlib.crc32(g.encode()) % DIMENSIONS for g in grams]


def foreign(words: Sequence[str]) -> bool:
    """Whether most words don't begin with a Latin letter."""
    return 2 * sum(w[0] > "\u024f" for w in words) > len(words)


def sentences(lines: Sequence[str]) -> list[tuple[int, list[str]]]:
    """(number of the line, words) of each sentence with words."""
    found = []
    for k, line in enumerate(lines):
        for sentence in SENTENCE_END.split(line):
            if words := WORD.findall(sentence.lower()):
                found.append((k, words))
    return found


def length_class(lens: np.ndarray) -> np.ndarray:
    return np.minimum(LENGTHS - 1, (4 * np.log2(lens)).astype(np.int64))


class Scorer:
    """Scores of sentences: the mean of their words' scores, each the mean of the weights of a word's features, plus the
    weights of the class of length."""

    def __init__(self, weights: np.ndarray, lengths: np.ndarray):
        self.weights, self.lengths = weights, lengths
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, self.weights.shape[1]), np.float32)

    def _row(self, word: str) -> int:
        k = self.known[word] = len(self.known)
        if k == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[k] = self.weights[features(word)].mean(axis=0)
        return k

    def __call__(self, found: Sequence[Sequence[str]]) -> np.ndarray:
        if len(self.known) > MOST_WORDS:
            self._forget()
        known, row = self.known, self._row
        rows = np.fromiter((known[w] if w in known else row(w) for words in found for w in words), np.int64)
        lens = np.array([len(words) for words in found])
        sums = np.add.reduceat(self.scores[rows], np.concatenate([[0], np.cumsum(lens)[:-1]]), axis=0)
        return sums / lens[:, None].astype(np.float32) + self.lengths[length_class(lens)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """Without the threads that a product of vectors would start, and keep busy, for work this small."""
    return float(np.einsum("i,i->", a, b))


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Where the convex ``f`` (value and gradient) is least, by L-BFGS from ``x``, to TOLERANCE of the gradient."""
    value, g = f(x)
    enough = TOLERANCE * math.sqrt(_dot(g, g))
    pairs: deque = deque(maxlen=6)
    for _ in range(MOST_STEPS):
        norm = math.sqrt(_dot(g, g))
        if norm <= enough:
            return x
        d, kept = g.copy(), []
        for s, y, sy in reversed(pairs):
            kept.append(a := _dot(s, d) / sy)
            d -= a * y
        d *= pairs[-1][2] / _dot(pairs[-1][1], pairs[-1][1]) if pairs else 1 / norm
        for (s, y, sy), a in zip(pairs, reversed(kept)):
            d += (a - _dot(y, d) / sy) * s
        slope, t = -_dot(d, g), 1.0
        while True:
            step = -t * d
            new_value, new_g = f(x + step)
            if new_value <= value + 1e-4 * t * slope:
                break
            t /= 2
            if t < 1e-9:
                warnings.warn(f"fit ended at gradient {norm:.3g}, tolerance {enough:.3g}", stacklevel=2)
                return x
        if (sy := _dot(step, new_g - g)) > 0:
            pairs.append((step, new_g - g, sy))
        x, value, g = x + step, new_value, new_g
    warnings.warn(f"fit ended at gradient {math.sqrt(_dot(g, g)):.3g}, tolerance {enough:.3g}", stacklevel=2)
    return x


def fit_sentences(found: list[list[str]], grade: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights, of features and of lengths, of two softmax heads (grades, then languages and "other") with an L2 penalty, fitted to TOLERANCE.

    ``grade`` and ``language`` give the class of each sentence, -1 where it has none; a head learns from the others.
    """
    heads = GRADES + len(LANGUAGES) + 1
    numbers: dict[str, int] = {}
    rows = np.fromiter((numbers.setdefault(w, len(numbers)) for words in found for w in words), np.int64)
    lens = np.array([len(words) for words in found])
    grams = [features(w) for w in numbers]
    gram_lens = np.array([len(g) for g in grams])
    gram_ids = np.fromiter((i for g in grams for i in g), np.int64)
    gram_word, word_sentence = np.repeat(np.arange(len(grams)), gram_lens), np.repeat(np.arange(len(found)), lens)
    # Words of a sentence that recur are one entry with a weight.
    pair, count = np.unique(word_sentence * len(grams) + rows, return_counts=True)
    word_sentence, rows, share = pair // len(grams), pair % len(grams), count / lens[pair // len(grams)]
    used, gram_ids = np.unique(gram_ids, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(gram_lens)[:-1]])
    first = np.flatnonzero(np.concatenate([[True], word_sentence[1:] != word_sentence[:-1]]))
    target = np.zeros((len(found), heads))
    for column, classes in ((0, grade), (GRADES, language)):
        ok = np.flatnonzero(classes >= 0)
        target[ok, column + classes[ok]] = 1
    masks = [(slice(0, GRADES), grade >= 0), (slice(GRADES, heads), language >= 0)]
    by_length = length_class(lens)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, lengths = x[:-LENGTHS], x[-LENGTHS:]
        word_scores = np.add.reduceat(weights[gram_ids], starts, axis=0) / gram_lens[:, None]
        scores = np.add.reduceat(word_scores[rows] * share[:, None], first, axis=0) + lengths[by_length]
        slope, value = np.zeros_like(scores), PENALTY / 2 * (x * x).sum()
        for columns, mask in masks:
            if mask.any():
                p, y = softmax(scores[mask, columns]), target[mask, columns]
                value -= np.log(np.maximum((p * y).sum(axis=1), 1e-300)).mean()
                slope[np.ix_(mask, range(columns.start, columns.stop))] = (p - y) / mask.sum()
        down = slope[word_sentence] * share[:, None]
        to_word = np.column_stack(
            [np.bincount(rows, down[:, c], len(grams)) for c in range(heads)]
        ) / gram_lens[:, None]
        up = to_word[gram_word]
        g = np.column_stack([np.bincount(gram_ids, up[:, c], len(used)) for c in range(heads)])
        gl = np.column_stack([np.bincount(by_length, slope[:, c], LENGTHS) for c in range(heads)])
        return value, np.concatenate([g, gl]) + PENALTY * x

    shape = (len(used) + LENGTHS, heads)

    def flat(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, g = loss(x.reshape(shape))
        return value, g.ravel()

    fitted = minimised(flat, np.zeros(shape).ravel()).reshape(shape)
    weights, lengths = fitted[:-LENGTHS], fitted[-LENGTHS:]
    full = np.zeros((DIMENSIONS, heads), np.float32)
    full[used] = weights
    return full, lengths.astype(np.float32)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method with an L2 penalty on all but the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], CALIBRATION_PENALTY * max(1, len(x)) / 10)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def document_features(levels: np.ndarray, words: np.ndarray) -> np.ndarray:
    """From sentences' grade distributions: the average distribution, weighted by words and unweighted, and the share of
    sentences whose likeliest grade is each."""
    top = np.eye(GRADES)[levels.argmax(axis=1)]
    return np.concatenate([(levels * words[:, None]).sum(axis=0) / words.sum(), levels.mean(axis=0), top.mean(axis=0)])


@dataclass
class Model:
    weights: np.ndarray
    lengths: np.ndarray
    #: One row per k of 2..5: coefficients of P(grade >= k) over the document features, intercept last.
    calibration: np.ndarray


def language_class(lang: str | None) -> int:
    """-1 without a label; labels such as EN or fr-FR count by their first part."""
    if not lang:
        return -1
    lang = re.split("[-_]", lang.lower())[0]
    return LANGUAGES.index(lang) if lang in LANGUAGES else len(LANGUAGES)


def fit(labelled: list[tuple[list[str], str | None, float | None]]) -> Model | None:
    """From (lines of main text, lang, grade) of labelled documents; a grade of None stands for documents that only have a
    language. None if nothing is graded."""
    docs = [lines for lines, _, _ in labelled]
    found = [(i, words) for i, lines in enumerate(docs) for _, words in sentences(lines)]
    doc = np.array([i for i, _ in found], np.int64)
    grades = np.array([-1 if g is None else round(g) - 1 for _, _, g in labelled], np.int64)
    languages = np.array([language_class(x) for _, x, _ in labelled], np.int64)
    if not len(doc) or not (grades[doc] >= 0).any():
        return None
    words = [w for _, w in found]
    n_words = np.array([len(w) for w in words], float)
    rows, goals = [], []
    for fold in (0, 1):
        inside = np.flatnonzero(doc % 2 == fold)
        other = np.flatnonzero((doc % 2 != fold) & (grades[doc] >= 0))
        if not len(inside) or not len(other):
            continue
        scorer = Scorer(*fit_sentences([words[i] for i in inside], grades[doc[inside]], languages[doc[inside]]))
        levels = softmax(scorer([words[i] for i in other])[:, :GRADES])
        for i in np.unique(doc[other]):
            mine = doc[other] == i
            rows.append(document_features(levels[mine], n_words[other][mine]))
            goals.append(labelled[i][2])
    weights, lengths = fit_sentences(words, grades[doc], languages[doc])
    if not rows:
        return Model(weights, lengths, np.zeros((GRADES - 1, 3 * GRADES + 1)))
    x, y = np.array(rows), np.array(goals)
    return Model(weights, lengths, np.array([fit_logistic(x, (y >= k).astype(float)) for k in range(2, GRADES + 1)]))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, main: DataFrame, most: int = LABELLED, most_chars: int = LABELLED_CHARS
) -> list[tuple[list[str], str | None, float | None]]:
    """(lines of main text, lang, grade) of at most ``most`` labelled documents with at most ``most_chars`` characters of main
    text. The grade is the median of the raters', null grades and repeated rows left out; without any it is None."""
    graded = labels.select("doc_id", "rater", "grade").distinct().groupBy("doc_id").agg(
        F.percentile("grade", F.lit(0.5)).alias("grade")
    )
    chosen = F.broadcast(written(graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "chosen"))
    texts = main.join(chosen, "doc_id", "left_semi")
    short = texts.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).filter(F.col("n") <= most_chars).select("doc_id")
    lines = defaultdict(list)
    for r in texts.join(F.broadcast(short), "doc_id").select("doc_id", "no", "text").orderBy("doc_id", "no").collect():
        lines[r["doc_id"]].append(r["text"])
    known = docs.select("doc_id", "lang").join(chosen, "doc_id").orderBy("doc_id").collect()
    return [(lines[r["doc_id"]], r["lang"], r["grade"]) for r in known if r["doc_id"] in lines]


NAMES = [
    *[f"m{k}" for k in range(GRADES)],
    *[f"u{k}" for k in range(GRADES)],
    *[f"t{k}" for k in range(GRADES)],
    *[f"l{k}" for k in range(len(LANGUAGES) + 1)],
]


def _split(id_type: pa.DataType):
    """Texts to the lines that may be main text."""
    names = ["doc_id", "no", "line", "context", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):
                owner, no, line, context, text, chars = [], [], [], [], [], 0
                while at < len(ids) and chars < 4_000_000:
                    lines = main_lines(texts[at])
                    hashes = [line_hash(x) for x in lines]
                    owner += [ids[at]] * len(lines)
                    no += range(len(lines))
                    line += hashes
                    context += contexts(hashes, lines)
                    text += lines
                    chars += len(texts[at] or "")
                    at += 1
                yield pa.record_batch(
                    [pa.array(owner, id_type), pa.array(no, pa.int32()), pa.array(line, pa.int64()), pa.array(context, pa.int64()), pa.array(text, pa.string())], names
                )

    return run


def main_text(docs: DataFrame) -> DataFrame:
    """doc_id, no, text: the lines of every document's main text, in order of ``no``. Null and empty texts have none.

    Lines are split off and hashed once and written; those that are notices in the whole corpus are then left out. There are
    at most as many notices as a document has lines on average, divided by CONTEXT_SHARE, so they are broadcast."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    lines = docs.select("doc_id", "text").mapInArrow(
        _split(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, no int, line bigint, context bigint, text string"
    )
    lines = written(lines, "lines")
    notices = lines.select("line", "context").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= least_contexts(docs.count())
    )
    return lines.join(F.broadcast(written(notices.select("line"), "notices")), "line", "left_anti").select("doc_id", "no", "text")


def _score(model, id_type: pa.DataType):
    names = ["doc_id", "words", "sentences", *NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value.weights, model.value.lengths)
        for batch in batches:
            found = sentences(batch.column(1).to_pylist())
            if not found:
                continue
            scores = scorer([w for _, w in found])
            levels, langs = softmax(scores[:, :GRADES]), softmax(scores[:, GRADES:])
            langs[[foreign(w) for _, w in found]] = np.eye(len(LANGUAGES) + 1)[-1]
            n = np.array([len(w) for _, w in found], np.float32)
            likeliest = np.eye(GRADES, dtype=np.float32)[levels.argmax(axis=1)]
            sums = np.column_stack([levels * n[:, None], levels, likeliest, langs * n[:, None]])
            place = np.array([k for k, _ in found])
            # Lines of a document follow each other: one row for each run of them.
            ids = batch.column(0).take(pa.array(place))
            changed = np.concatenate([[True], np.asarray(pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_pylist(), bool)])
            first = np.flatnonzero(changed)
            columns = np.add.reduceat(sums, first, axis=0).astype(np.float32)
            count = np.diff(np.concatenate([first, [len(place)]])).astype(np.int32)
            total = np.add.reduceat(n, first).astype(np.int32)
            yield pa.record_batch(
                [ids.take(pa.array(first)).cast(id_type), pa.array(total), pa.array(count), *[pa.array(columns[:, i]) for i in range(len(NAMES))]],
                names,
            )

    return run


def levels(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, words, language, level and p_demanding of every document with main text.

    ``words`` counts the words of the main text, ``language`` is its likeliest of de, en, es, fr and other, ``level``
    the expected grade (1 to 5) and ``p_demanding`` the probability of grade 4 or 5. Null, empty and wordless texts and
    pages that hold only notices give no row, nor does any document if no label is given. ``doc_id`` must be unique; other
    columns besides text and lang don't matter. All documents are scored as wholes; only the fit uses a sample.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    main = main_text(docs)
    model = fit(labelled_sample(docs, labels, main, labelled))
    if model is None:
        return docs.limit(0).select(
            "doc_id",
            F.lit(0).cast("bigint").alias("words"),
            F.lit("").alias("language"),
            F.lit(0.0).alias("level"),
            F.lit(0.0).alias("p_demanding"),
        )
    sent = spark.sparkContext.broadcast(model)  # of a fixed size: DIMENSIONS by 10 numbers
    schema = f"doc_id {kind.simpleString()}, words int, sentences int, " + ", ".join(f"{n} float" for n in NAMES)
    scored = main.select("doc_id", "text").mapInArrow(_score(sent, to_arrow_type(kind)), schema)
    summed = scored.groupBy("doc_id").agg(
        F.sum("words").alias("words"), F.sum("sentences").alias("sentences"), *[F.sum(n).alias(n) for n in NAMES]
    )
    x = [
        *[F.col(f"m{k}") / F.col("words") for k in range(GRADES)],
        *[F.col(f"{n}{k}") / F.col("sentences") for n in "ut" for k in range(GRADES)],
    ]
    at_least = []
    for row in model.calibration:
        z = F.lit(float(row[-1]))
        for w, c in zip(row, x):
            z = z + F.lit(float(w)) * c
        at_least.append(1 / (1 + F.exp(-z)))
    language = F.array_max(
        F.array(
            *[F.struct(F.col(f"l{k}").alias("s"), F.lit(n).alias("n")) for k, n in enumerate((*LANGUAGES, "other"))]
        )
    )["n"]
    level = F.lit(1.0)
    for p in at_least:
        level = level + p
    return summed.select(
        "doc_id", "words", language.alias("language"), level.alias("level"), at_least[2].alias("p_demanding")
    )


def demanding(scored: DataFrame, least_words: int = 60) -> DataFrame:
    """The documents in one of the four languages, with at least ``least_words``, that read at grade 4 or 5."""
    return scored.filter(
        F.col("language").isin(*LANGUAGES) & (F.col("words") >= least_words) & (F.col("p_demanding") >= 0.5)
    )

