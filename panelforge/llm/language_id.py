"""Language identification by nearest centroids of TF-IDF letter n-grams.

A text is its counts of letter pairs and triples (letters lower-cased, everything else a word border), hashed into DIMS
places, weighted by inverse document frequency and brought to length 1. Each language has a few centroids from spherical
k-means over its training vectors; a text takes the language of the centroid with the largest cosine. A text that lies
farther from its centroid than training texts of its size do is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from panelforge.llm.common import broadcast_if_small, fresh, give_back_memory, ship_package, text_batches, without, written

DIMS = 4096
#: The model is fitted on at most so many labelled texts of each language, taken in the order of a hash of id and text.
TRAIN_TEXTS = 400
CENTROIDS, ROUNDS = 3, 12
#: A centroid keeps at least this share of its language's training texts, so that a few mislabelled ones make none.
LEAST_SHARE = 0.05
#: A text is rejected below MARGIN times the FLOOR quantile of the cosines that training texts of its size class or a larger one have;
#: classes with fewer than LEAST_CLASS such texts take the bound of the class before.
MARGIN, FLOOR, LEAST_CLASS = 0.5, 0.03, 20
#: Texts with fewer n-grams say too little to be rejected, unless the model knows none of them.
LEAST_GRAMS = 64
UNDETERMINED = "und"
#: Bytes of text that are counted at once (arrays of about 60 times that), the length of a part of a long text, and texts counted at once.
SPLIT_BYTES, PART, TOGETHER = 1 << 18, 1 << 17, 64

_lower = np.full(0x110000, -1, np.int32)


def _fold(points: np.ndarray) -> np.ndarray:
    """Lower-case letters, 0 for everything else."""
    out = _lower[points]
    if (out < 0).any():
        for p in np.unique(points[out < 0]).tolist():
            c = chr(p)
            _lower[p] = ord(c.lower()[0]) if c.isalpha() else 0
        out = _lower[points]
    return out


def _parts(text: str) -> list[str]:
    """A very long text in parts, cut before a character that is no letter where there is one."""
    out, at = [], 0
    while len(text) - at > PART:
        cut = re.compile(r"[\W\d_]").search(text, at + PART)
        end = cut.start() if cut else at + 2 * PART
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def ngram_counts(texts: list[str]) -> np.ndarray:
    """(texts, DIMS) counts of hashed letter pairs and triples; the border of a word is a letter, a triple has none inside."""
    owner, parts = [], []
    for i, t in enumerate(texts):
        own = _parts(t) if len(t) > PART else [t]
        parts += own
        owner += [i] * len(own)
    out = np.zeros((len(texts), DIMS))
    at = 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end]) <= SPLIT_BYTES) and end - at < TOGETHER:
            size += len(parts[end])
            end += 1
        joined = " " + " ".join(parts[at:end]) + " "
        lens = np.fromiter((len(p) + 1 for p in parts[at:end]), np.int64, end - at)
        doc = np.concatenate([[0], np.repeat(np.arange(end - at), lens)])
        seq = _fold(np.frombuffer(joined.encode("utf-32-le"), np.uint32))
        keep = np.ones(len(seq), bool)
        keep[1:] = (seq[1:] != 0) | (seq[:-1] != 0)
        seq, doc = seq[keep].astype(np.uint64), doc[keep]
        a, b = seq[:-1], seq[1:]
        pair = (a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
        who = np.where(a == 0, doc[1:], doc[:-1])
        grams, whose = [pair >> np.uint64(52)], [who]
        if len(seq) > 2:
            c, inner = seq[2:], b[:-1] != 0
            triple = (pair[:-1][inner] ^ (c[inner] + np.uint64(7)) * np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB)
            grams.append(triple >> np.uint64(52))
            whose.append(doc[1:-1][inner])
        flat = np.concatenate(whose) * DIMS + np.concatenate(grams).astype(np.int64)
        counts = np.bincount(flat, minlength=(end - at) * DIMS).reshape(end - at, DIMS)
        np.add.at(out, np.array(owner[at:end]), counts)
        at = end
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray  # smallest accepted cosine by size class

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = counts * self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        v /= np.where(norm > 0, norm, 1)
        return v

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the nearest centroid, cosine, rejected) of each row."""
        cos = self.vectors(counts) @ self.centroids.T
        best = cos.argmax(1)
        top = cos[np.arange(len(cos)), best]
        n = counts.sum(1)
        return best, np.clip(top, 0, 1), (top <= 0) | ((n >= LEAST_GRAMS) & (top < self.floors[size_class(n)]))


def size_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), 15)


def _spherical_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of unit rows by cosine; starts from the mean's nearest row, then the rows farthest from those chosen."""
    chosen = [int((x @ x.mean(0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        new = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        new /= np.linalg.norm(new, axis=1, keepdims=True)
        if np.allclose(new, c):
            break
        c = new
    return c


def fit_language(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, n-grams of each text that is used, its cosine with the nearest centroid) of one language's training counts.

    While the smallest centroid has fewer than LEAST_SHARE of the texts, its texts are set aside and the rest is fitted again; once
    more than twice that share would be set aside, there is one centroid less.
    """
    x = Model([], idf.astype(np.float32), np.zeros((0, DIMS)), np.zeros(16)).vectors(counts)
    k, used, sizes = min(CENTROIDS, len(x)), x, counts.sum(1)
    while True:
        c = _spherical_means(used, k, ROUNDS)
        near = (used @ c.T).argmax(1)
        members = np.bincount(near, minlength=len(c))
        least = int(members.argmin())
        if members[least] >= LEAST_SHARE * len(x) or k == 1:
            break
        if members[least] and len(used) - members[least] >= (1 - 2 * LEAST_SHARE) * len(x):
            used, sizes = used[near != least], sizes[near != least]
        else:
            k -= 1
    return c, sizes, (used @ c.T).max(1)


def floors_of(sizes: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The least accepted cosine of each size class."""
    floors, last = np.zeros(16), 0.0
    for k in range(16):
        own = cosines[size_class(sizes) >= k]
        if len(own) >= LEAST_CLASS or (k == 0 and len(own)):
            last = MARGIN * float(np.quantile(own, FLOOR))
        floors[k] = last
    return floors


def _dense(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    counts = np.zeros((table.num_rows, DIMS), np.float32)
    for i, (at, n) in enumerate(zip(table.column("at").to_pylist(), table.column("n").to_pylist())):
        counts[i, np.frombuffer(at, "<i2")] = np.frombuffer(n, "<i8")
    return counts


def _presence(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts have each n-gram place; place -1 counts the texts."""
    total, texts = np.zeros(DIMS, np.int64), 0
    for batch in it:
        texts += batch.num_rows
        for at in batch.column(1).to_pylist():
            total[np.frombuffer(at, "<i2")] += 1
    yield pa.RecordBatch.from_arrays([pa.array([-1, *range(DIMS)], pa.int32()), pa.array([texts, *total.tolist()], pa.int64())], names=["place", "n"])


_FITTED = "lang string, centroids binary, sizes binary, cosines binary"


def _fit_group(idf: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("at", "ascending"), ("n", "ascending")])
        data = [a.astype("<f8").tobytes() for a in fit_language(_dense(rows), idf)]
        return pa.table([rows.column("lang").slice(0, 1).combine_chunks(), *[pa.array([d], pa.binary()) for d in data]], names=[f.split()[0] for f in _FITTED.split(", ")])

    return run


def _vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(it, "text", SPLIT_BYTES):
        pairs = [(lang, t) for lang, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) if has_letter(t)]
        if pairs:
            counts = ngram_counts([t for _, t in pairs]).astype(np.int64)
            at = [np.flatnonzero(row) for row in counts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang for lang, _ in pairs], pa.string()),
                    pa.array([a.astype("<i2").tobytes() for a in at], pa.binary()),
                    pa.array([row[a].astype("<i8").tobytes() for row, a in zip(counts, at)], pa.binary()),
                ],
                names=["lang", "at", "n"],
            )


def train(labelled: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", texts: int = TRAIN_TEXTS) -> Model:
    """Fit on at most ``texts`` rows of each language (the smallest hashes of id and text); rows without label or letters are left out.

    Each language is fitted by a task of its own, from at most ``texts`` rows. The driver gets the document frequency of each n-gram
    place and, of a language, its centroids and a size and cosine for each of its training texts. Repeated rows count each; without any
    usable row every later text is undetermined.
    """
    ship_package(labelled.sparkSession)
    use = labelled.where(F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    use = use.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # Of a language's n usable texts those below a hash that about twice the wanted number stay under, so that few texts are shuffled.
    sizes = use.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    drawn = use.join(broadcast_if_small(written(sizes, "language-sizes")), "lang").where(F.col("h").cast("double") * F.col("_n") < F.lit(float(2 * texts + 100)) * (1 << 40)).drop("_n")
    nearest = W.partitionBy("lang").orderBy("h", F.length("text"), "text")
    sample = drawn.withColumn("_rank", F.row_number().over(nearest)).where(F.col("_rank") <= texts).select("h", "lang", "text")
    vectors = written(sample.mapInArrow(_vectors, "lang string, at binary, n binary"), "language-vectors")
    seen = dict(map(tuple, vectors.mapInArrow(_presence, "place int, n long").groupBy("place").agg(F.sum("n")).collect()))
    if not seen.get(-1):
        return Model([], np.zeros(DIMS), np.zeros((0, DIMS)), np.zeros(16))
    idf = np.log((1 + seen[-1]) / (1 + np.array([seen[k] for k in range(DIMS)]))) + 1
    found = sorted(vectors.groupBy("lang").applyInArrow(_fit_group(idf), _FITTED).collect(), key=lambda r: r["lang"])
    centroids = [np.frombuffer(r["centroids"], "<f8").reshape(-1, DIMS) for r in found]
    floors = floors_of(*[np.concatenate([np.frombuffer(r[c], "<f8") for r in found]) for c in ("sizes", "cosines")])
    return Model([r["lang"] for r, c in zip(found, centroids) for _ in c], idf, np.concatenate(centroids), floors)


def _predict(model: Model, at: int, names: tuple[str, str, str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for batch in text_batches(it, at, SPLIT_BYTES):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            lang, score, away = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            some = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
            for k in range(0, len(some), TOGETHER):
                part = some[k : k + TOGETHER]
                best, top, rejected = model.predict(ngram_counts([texts[i] for i in part]))
                score[part], away[part] = top, rejected
                for i, b in zip(part, best.tolist()):
                    lang[i] = model.languages[b]
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(lang, pa.string()), pa.array(score), pa.array(away)],
                names=[*[n for i, n in enumerate(batch.schema.names) if i != at], *names],
            )

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with three columns ``names``: language, score (cosine, 0 to 1) and whether the text is rejected.

    A null text or one without a letter is ``und`` with score 0 and rejected; any other text gets the nearest centroid's
    language, also when it is rejected as too far away. Of equal cosines the first centroid in the order of languages
    counts. Columns of ``docs`` named like the new ones are replaced; repeated rows each get their own; an empty table stays empty.
    """
    ship_package(docs.sparkSession)
    copy = fresh(docs, "_text")[0]
    read = without(docs.withColumn(copy, F.col(text_col)), *names)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1]]
    schema = ", ".join([*fields, *[f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "boolean"))]])
    return read.mapInArrow(_predict(model, len(read.columns) - 1, names), schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
