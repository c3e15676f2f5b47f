"""Files that were not written by hand: generated, minified, third-party copies, data saved as code.

Three linear support-vector classifiers decide, and nothing behind them. One reads hashed components of a path and
character n-grams of its directories. The second reads hashed character n-grams of a text's body, with the opening
comments, where headers give a file away, masked. The third reads those of the opening comments themselves, line by line,
since a notice is a line of its own however long a licence stands around it. Labels come from what gives a file away:
the names that tools and conventions give to paths, the shape of bodies, and the wording of notices; a path whose file
carries a notice under an ordinary name, and an unmarked line next to a notice, are examples of neither side. All are
fitted on bounded samples; part of the repositories is kept for validation. Every row of every table is then scored
where it lies: a file is a case if its path, its governing package's path, its body or a line of its opening comments
scores above the classifier's threshold.

Defined cases: paths are written with forward slashes and without leading ``./``; rows without a path are left out;
null and empty texts are judged by path alone; repeated rows give one row; a sample without cases of a kind gives a
classifier that finds none of that kind.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: What the classifiers are fitted on at most, chosen by hash: distinct paths of each label; files looked at, and of those
#: the unmarked ones that are kept; distinct lines of opening comments of each label.
PATH_SAMPLE, FILE_SAMPLE, PLAIN_SAMPLE, LINE_SAMPLE = 6_000, 20_000, 4_000, 3_000
PATH_BUCKETS, TEXT_BUCKETS = 1 << 20, 1 << 12
#: Characters of a n-gram, of texts and of directory names, and the share of repositories kept for validation.
NGRAM, DIR_NGRAM, VALIDATION = 4, 5, 0.2
#: Path components must occur in so many repositories, so that no single project's names count.
LEAST_REPOS = 3

# Names that tools and conventions give to directories and files of the kind.
_DIRS = "node_modules bower_components site-packages third_party third-party thirdparty vendor vendored _vendor external externals wwwroot generated __generated__ _generated generated-sources generated_sources gen dist build out obj"
_NAMES = r"(?:[.-]min\.[cm]?js|\.bundle\.js|\.[0-9a-f]{8,}\.chunk\.js|\.chunk\.js|_pb2(?:_grpc)?\.py|\.pb\.[a-z]+|\.g\.cs|\.designer\.cs|\.generated\.[a-z]+|\.gen\.[a-z]+)$"
# What notices in opening comments say.
_NOTICE = re.compile(
    r"@generated\b|</?auto-?generated\b|\bauto-?generated (?:file|code|by|from)\b|\bcode generated\b|\b(?:generated|produced|emitted|created) (?:by|from|automatically)\b.{0,80}\bdo not (?:edit|modify|change)\b|\bdo not (?:edit|modify|patch)\b|\boutput of \S+, source\b"
    r"|\bgenerated automatically\b|\bautomatisch (?:erzeugt|generiert)\b|\bnicht von hand\b|\bmachine[- ](?:written|generated|made)\b|\b(?:written|produced|created|emitted) by \S+ and (?:is|will be) (?:replaced|overwritten|regenerated)\b"
    r"|\bvendored (?:copy|from)\b|^\W*third[- ]party: |\bcopied (?:verbatim )?from upstream\b|\bredistributed (?:unchanged|without changes)\b|^\W*!\s*\S+ v?\d+\.\d+|\(c\) \d{4} the [\w-]+ contributors\b",
    re.I | re.M,
)
_HEAD = re.compile(r"\A(?:\s+|#![^\n]*|/\*[\s\S]*?\*/|//[^\n]*|#[^\n]*|<!--[\s\S]*?-->|[\"']use strict[\"'];?)*")
_MAPPING = re.compile(r"//[#@] sourceMappingURL=\S*")


def clean_path(c: Column) -> Column:
    """A path with forward slashes and without leading ``./``; null where nothing is left."""
    out = F.regexp_replace(F.replace(F.btrim(c), F.lit("\\"), F.lit("/")), r"^(?:\./+)+", "")
    return F.when(out != "", out)


def opening(text: str) -> str:
    """The comments and blanks that a text opens with."""
    return _HEAD.match(text)[0]


def notice(line: str) -> bool:
    """Whether a line of opening comments is worded as a notice of a generated or copied file; for labels only."""
    return bool(_NOTICE.search(line))


def tool_named(path: str) -> bool:
    """Whether a path carries a name that tools or conventions give."""
    low = path.lower()
    return bool(set(low.split("/")[:-1]) & set(_DIRS.split())) or bool(re.search(_NAMES, low))


def shaped(text: str) -> bool:
    """Whether a text has the shape of minified code or of data: dense long lines, or literals throughout."""
    body = text[len(opening(text)) :]
    if len(body) < 200:
        return False
    longest = max(map(len, body.split("\n")))
    blank = sum(map(body.count, (" ", "\n", "\t", "\r"))) / len(body)
    literal = sum(len(m) for m in re.findall(r"(?:0x[\da-fA-F]+|\b\d+)\s*,", body)) / len(body)
    return literal > 0.6 or longest > 500 and blank < 0.06


def path_features(path: str) -> list[int]:
    """Buckets of a path's components and of the n-grams of its directories."""
    parts = [re.sub(r"[-@]?v?\d+(?:\.\d+)+", "#", p) for p in path.strip("/").lower().split("/")]
    dirs, name = parts[1:-1], parts[-1]
    stem, _, chain = name.partition(".")
    chain = re.sub(r"\b[0-9a-f]{6,}\b", "#", chain)
    out = [f"d:{d}" for d in dirs] + [f"p:{a}/{b}" for a, b in zip(dirs, dirs[1:])] + [f"x:.{chain}"]
    out += [f"y:.{chain.rpartition('.')[0]}"] if "." in chain else []
    out += [f"g:{f'^{d}$'[k : k + DIR_NGRAM]}" for d in dirs for k in range(len(d) + 3 - DIR_NGRAM)]
    words = re.split(r"([-_])", stem)
    if len(words) > 2:
        out += [f"e:{''.join(words[-2:])}", f"b:{''.join(words[:2])}"]
    if len(words) > 4:
        out += [f"e:{''.join(words[-4:])}", f"b:{''.join(words[:4])}"]
    return sorted({zlib.crc32(x.encode()) % PATH_BUCKETS for x in out})


def _buckets(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that start at the given places of a row of bytes."""
    h = raw[at] * np.uint32(0x9E3779B1)
    for k in range(1, NGRAM):
        h = (h ^ raw[at + k]) * np.uint32(0x85EBCA6B)
    return ((h >> np.uint32(20)) & np.uint32(TEXT_BUCKETS - 1)).astype(np.int64)


def ngrams(part: str) -> np.ndarray:
    """Counts of a passage's n-grams by bucket, dampened and of length 1."""
    raw = np.frombuffer(part.encode(), np.uint8).astype(np.uint32)
    if len(raw) < NGRAM:
        return np.zeros(TEXT_BUCKETS, np.float32)
    counts = np.bincount(_buckets(raw, np.arange(len(raw) - NGRAM + 1)), minlength=TEXT_BUCKETS).astype(np.float32)
    out = np.sqrt(counts)
    return out / np.float32(np.sqrt((out * out).sum()))


def text_features(text: str) -> np.ndarray:
    """The n-grams of a text's body; opening comments and source maps are masked."""
    return ngrams(_MAPPING.sub("", text[len(opening(text)) :]))


def opening_lines(text: str) -> list[str]:
    """The different lines of the comments that a text opens with."""
    return list(dict.fromkeys(x for line in opening(text).split("\n") if (x := line.strip())))


def line_scores(lines: list[str], weights: np.ndarray) -> np.ndarray:
    """The product of the weights with ``ngrams`` of each line, for all lines at once."""
    raw = [np.frombuffer(x.encode(), np.uint8) for x in lines]
    size = np.array([max(0, len(r) - NGRAM + 1) for r in raw], np.int64)
    if not size.sum():
        return np.zeros(len(lines))
    line = np.repeat(np.arange(len(lines)), size)
    start = np.cumsum([0, *(len(r) for r in raw[:-1])])
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    bucket = _buckets(np.concatenate(raw).astype(np.uint32), at)
    key, count = np.unique(line * TEXT_BUCKETS + bucket, return_counts=True)
    own, root = key // TEXT_BUCKETS, np.sqrt(count)
    norm = np.sqrt(np.bincount(own, count, len(lines)))
    return np.bincount(own, root * weights[key % TEXT_BUCKETS], len(lines)) / np.maximum(norm, 1e-9)


@dataclass(frozen=True)
class Linear:
    """Weights, threshold, and how the validation repositories were judged."""

    weights: np.ndarray
    threshold: float
    report: dict[str, float]


def _report(score: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Rows of the validation repositories, precision and recall at score 0, and rows that only the classifier or only
    the label calls a case."""
    hit, said, true = float(((score > 0) & (y > 0)).sum()), float((score > 0).sum()), float((y > 0).sum())
    return {"rows": float(len(y)), "precision": hit / said if said else 1.0, "recall": hit / true if true else 1.0, "found_alone": said - hit, "labelled_alone": true - hit}


_NOTHING = {"rows": 0.0, "precision": 1.0, "recall": 1.0, "found_alone": 0.0, "labelled_alone": 0.0}


def _fit(times, back, n: int, size: int, y: np.ndarray, weight: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Squared hinge loss by accelerated gradient steps; ``times(w)`` gives scores, ``back(g)`` their gradient."""
    w = np.zeros(size + 1)
    v, t = w.copy(), 1.0
    scale = 2.0 * float((weight).sum()) / max(n, 1) + ridge
    step = 1.0 / (scale * max(1.0, times.norm))
    for _ in range(rounds):
        slack = np.maximum(0.0, 1 - y * (times(v[:-1]) + v[-1])) * weight * y
        g = np.append(back(slack), slack.sum()) * (-2.0 / max(n, 1)) + ridge * v
        new = v - step * g
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / nt * (new - w)
        w, t = new, nt
    return w


def fit_paths(rows: list[tuple[str, str, int]]) -> Linear:
    """A classifier from ``(repo, path, label)``, label 1 for cases."""
    feats = [path_features(p) for _, p, _ in rows]
    repos: dict[int, set[str]] = {}
    for (repo, _, _), f in zip(rows, feats):
        for k in f:
            seen = repos.setdefault(k, set())
            if len(seen) < LEAST_REPOS:
                seen.add(repo)
    least = min(LEAST_REPOS, len({r for r, _, _ in rows}) or 1)
    kept = np.zeros(PATH_BUCKETS, bool)
    kept[[k for k, s in repos.items() if len(s) >= least]] = True
    feats = [[k for k in f if kept[k]] for f in feats]
    y = np.array([1.0 if label else -1.0 for _, _, label in rows])
    held = np.array([zlib.crc32(r.encode()) % 100 < 100 * VALIDATION for r, _, _ in rows], bool)
    if not len(rows) or not (y[~held] > 0).any():
        return Linear(np.zeros(PATH_BUCKETS, np.float32), 1.0, _NOTHING)
    train = np.flatnonzero(~held)
    at = np.repeat(np.arange(len(train)), [len(feats[k]) for k in train])
    used, col = np.unique(np.array([c for k in train for c in feats[k]], np.int64), return_inverse=True)

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(at, w[col], len(train))

    times.norm = float(max((len(feats[k]) for k in train), default=1))
    small = _fit(times, lambda g: np.bincount(col, g[at], len(used)), len(train), len(used), y[train], np.ones(len(train)), rounds=300, ridge=1e-5)
    w = np.zeros(PATH_BUCKETS + 1)
    w[used], w[-1] = small[:-1], small[-1]
    score = np.array([w[f].sum() + w[-1] for f, h in zip(feats, held) if h]) if held.any() else np.zeros(0)
    return Linear(w[:-1].astype(np.float32), float(-w[-1]), _report(score, y[held]))


def fit_texts(rows: list[tuple[str, np.ndarray, int]]) -> Linear:
    """A classifier from ``(repo, features, label)``."""
    empty = Linear(np.zeros(TEXT_BUCKETS, np.float32), 1.0, _NOTHING)
    y = np.array([1.0 if label else -1.0 for _, _, label in rows])
    if not len(rows):
        return empty
    x = np.stack([f for _, f, _ in rows])
    held = np.array([zlib.crc32(r.encode()) % 100 < 100 * VALIDATION for r, _, _ in rows], bool)
    if not (y[~held] > 0).any():
        return empty
    own = x[~held]

    def times(w: np.ndarray) -> np.ndarray:
        return (own @ w.astype(np.float32)).astype(np.float64)

    times.norm = 1.0
    many = (y[~held] < 0).sum() / max(1, (y[~held] > 0).sum())
    w = _fit(times, lambda g: (g.astype(np.float32) @ own).astype(np.float64), len(own), TEXT_BUCKETS, y[~held], np.where(y[~held] > 0, many, 1.0), rounds=200)
    return Linear(w[:-1].astype(np.float32), float(-w[-1]), _report(x[held] @ w[:-1] + w[-1], y[held]))


def _sparse(features: np.ndarray) -> bytes:
    """Buckets and values of what is not zero, as two runs of two bytes each."""
    at = np.flatnonzero(features)
    return at.astype(np.uint16).tobytes() + features[at].astype(np.float16).tobytes()


def _dense(packed: bytes) -> np.ndarray:
    out = np.zeros(TEXT_BUCKETS, np.float32)
    half = len(packed) // 2
    out[np.frombuffer(packed[:half], np.uint16)] = np.frombuffer(packed[half:], np.float16)
    return out


def _below(key: str, share: float) -> Column:
    """Whether a row belongs to a share of all rows, by the hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def sample_files(docs: DataFrame) -> DataFrame:
    """``(path, repo, shaped, noticed, body, lines, marks)`` of a sample of files: whether the body has the shape of a case,
    whether a line is worded as a notice, the body's features, the opening lines and which of them are notices.

    ``FILE_SAMPLE`` files at most are looked at, about; of those without either sign as many as ``PLAIN_SAMPLE`` are
    kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, repo, text, plain in zip(*(c.to_pylist() for c in batch.columns)):
                lines = opening_lines(text)
                marks = [notice(x) for x in lines]
                case = shaped(text)
                if plain or case or any(marks):
                    out.append((path, repo, case, any(marks), _sparse(text_features(text)), lines, marks))
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["path", "repo", "shaped", "noticed", "body", "lines", "marks"])

    rows = docs.select(clean_path(F.col("file_path")).alias("path"), F.coalesce("repo", F.lit("")).alias("repo"), "text")
    n = max(1, rows.where(F.col("path").isNotNull()).count())
    chosen = rows.where(F.col("path").isNotNull() & F.col("text").isNotNull() & _below("path", FILE_SAMPLE / n)).withColumn("plain", _below("path", PLAIN_SAMPLE / n))
    return chosen.mapInArrow(run, "path string, repo string, shaped boolean, noticed boolean, body binary, lines array<string>, marks array<boolean>")


def sample_paths(paths: list[DataFrame]) -> list[str]:
    """Different paths that ``found`` judges, ``4 * PATH_SAMPLE`` at most, about."""
    every = reduce(DataFrame.unionByName, [p.select("judged") for p in paths]).where(F.col("judged").isNotNull())
    n = max(1, every.agg(F.approx_count_distinct("judged")).collect()[0][0])
    return sorted(r.judged for r in every.where(_below("judged", 4 * PATH_SAMPLE / n)).distinct().collect())


def _line_rows(files: list) -> list[tuple[str, np.ndarray, int]]:
    """``(repo, features, label)`` of different opening lines: notices, and lines of files without one."""
    told: dict[str, tuple[str, int]] = {}
    for r in files:
        for line, mark in zip(r.lines, r.marks):
            if mark or not r.noticed:
                told.setdefault(line, (r.repo, int(mark)))
    order = sorted(told, key=lambda x: zlib.crc32(x.encode()))
    kept = [x for label in (1, 0) for x in [x for x in order if told[x][1] == label][:LINE_SAMPLE]]
    return [(told[x][0], ngrams(x), told[x][1]) for x in kept]


def fit(docs: DataFrame, paths: list[DataFrame]) -> tuple[Linear, Linear, Linear]:
    """The classifiers of paths, bodies and opening lines, fitted on ``sample_paths`` and ``sample_files``.

    ``paths`` is as for ``found``; the first part of a path is its repository.
    """
    files = sorted(sample_files(docs).collect(), key=lambda r: (r.path, r.body))
    told = {r.path for r in files if r.noticed or r.shaped}
    named: tuple[list[str], list[str]] = ([], [])
    for p in sorted(sample_paths(paths), key=lambda x: zlib.crc32(x.encode())):
        if len(named[label := int(tool_named(p))]) < PATH_SAMPLE and (label or p not in told):
            named[label].append(p)
    bodies = [(r.repo, _dense(r.body), int(r.shaped)) for r in files if r.shaped or not r.noticed]
    return (
        fit_paths([(p.split("/")[0], p, label) for label in (0, 1) for p in named[label]]),
        fit_texts(bodies),
        fit_texts(_line_rows(files)),
    )


def _score_paths(column: pa.Array, model: Linear) -> np.ndarray:
    """Scores of distinct paths of a batch, gathered back to its rows."""
    coded = column.dictionary_encode()
    known = coded.dictionary.to_pylist()
    score = np.array([model.weights[path_features(p)].sum() - model.threshold for p in known] + [-1.0], np.float32)
    at = coded.indices.to_numpy(zero_copy_only=False)
    return score[np.where(np.isnan(at.astype(float)), len(known), at.astype(float)).astype(np.int64)] if column.null_count else score[at]


def found(docs: DataFrame, paths: list[DataFrame], models: tuple[Linear, Linear, Linear]) -> DataFrame:
    """``(file_path, reason)`` of every case, once per reason.

    ``paths`` are frames ``(file_path, judged)``: the path to report, and a path that speaks for it, its own or its
    governing package's.
    """
    by_path, by_text, by_opening = models

    def judge_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(_score_paths(batch.column(1), by_path) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit)], ["file_path"])

    def judge_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple[str, str]] = []
            lines = [opening_lines(t) for t in text]
            known = {x: k for k, x in enumerate({x for own in lines for x in own})}
            score = line_scores(list(known), by_opening.weights)
            for p, t, own in zip(path, text, lines):
                if float(text_features(t) @ by_text.weights) > by_text.threshold:
                    out.append((p, "text"))
                if any(score[known[x]] > by_opening.threshold for x in own):
                    out.append((p, "notice"))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["file_path", "reason"])

    own = docs.select(clean_path(F.col("file_path")).alias("file_path"), "text").where(F.col("file_path").isNotNull() & (F.col("text") != ""))
    hits = own.mapInArrow(judge_texts, "file_path string, reason string")
    named = reduce(DataFrame.unionByName, [frame.where(F.col("file_path").isNotNull() & F.col("judged").isNotNull()).distinct() for frame in paths])
    return hits.unionByName(named.mapInArrow(judge_paths, "file_path string").withColumn("reason", F.lit("path"))).distinct()
