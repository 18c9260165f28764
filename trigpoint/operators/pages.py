"""Pages of places, and how queries meet them.

A page is a cube of a few hundred places. A partition has its pages one after the other, in each its places first and then queries, so a task holds the places of
one page and a batch of queries, whatever the number of either. They are compared as unit vectors, and what is best or within rounding of it is given; which of
these is the best, Spark tells by its own distances.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geo import RADIUS

#: Pairs that are compared at once.
_PAIRS = 1 << 20
#: What rounding makes at most: of a product of unit vectors, of an angle (some 1 mm), and of a score by its share.
_PRODUCT, _ANGLE, _SHARE = 1e-14, 2e-10, 1e-6


def _vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def _gravity(population: np.ndarray, chord2: np.ndarray) -> np.ndarray:
    """From squares of chords."""
    km = 2 * RADIUS * np.arcsin(np.minimum(1.0, np.sqrt(chord2) / 2))
    return population / (km * km + 1)


class Pages:
    """rows: (begins, least x, y, z, width, most, x, y, z) of pages in order: the first of its points by their order, its cube, its largest population and the unit
    vector of a place that has it. weighed: places are compared by gravity. What a query reaches is a score, or the product of unit vectors."""

    def __init__(self, rows: list[tuple], weighed: bool):
        self.weighed = weighed
        self.begins = np.array([r[0] for r in rows], np.int64)
        table = np.array([r[1:] for r in rows], np.float64).reshape(-1, 8)
        self.corner, self.width, self.most, self.place = table[:, :3], table[:, 3:4], table[:, 4], table[:, 5:]

    def of(self, at: Column) -> Column:
        """The page that a point is in or, of one that is in none, the one before it."""
        begins = self.begins

        def page(at: pa.Array) -> pa.Array:
            return pa.array(np.maximum(np.searchsorted(begins, at.to_numpy(zero_copy_only=False), "right") - 1, 0), pa.int32())

        page.__annotations__ = {"at": pa.Array, "return": pa.Array}
        return F.arrow_udf(page, "int")(at)

    def _scores(self, product: np.ndarray, population: np.ndarray) -> np.ndarray:
        return _gravity(population, np.maximum(0.0, 2 - 2 * product)) if self.weighed else product

    def _least(self, reached: np.ndarray) -> np.ndarray:
        """What a place must have so that it may be the best."""
        if self.weighed:
            return reached * (1 - _SHARE)
        return reached - _PRODUCT - _ANGLE * np.sqrt(np.maximum(0.0, 1 - np.minimum(1.0, reached * reached)))

    def _best(self, points: np.ndarray, reached: np.ndarray, places: np.ndarray, population: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, places) that may be the best of a query, and what queries reach."""
        reached, found = reached.copy(), []
        step = max(1, _PAIRS // len(places))
        for k in range(0, len(points), step):
            own = slice(k, k + step)
            product = points[own] @ places.T
            if self.weighed:  # chords are shorter than arcs, so this is no less than the score
                most = population / (RADIUS * RADIUS * np.maximum(0.0, 2 - 2 * product) + 1)
                first = most.argmax(axis=1)
                reached[own] = np.maximum(reached[own], self._scores(product[np.arange(len(first)), first], population[first]))
                i, j = np.nonzero(most >= self._least(reached[own])[:, None])
                score = self._scores(product[i, j], population[j])
                np.maximum.at(reached[own], i, score)
                enough = score >= self._least(reached[own])[i]
                i, j = i[enough], j[enough]
            else:
                reached[own] = np.maximum(reached[own], product.max(axis=1))
                i, j = np.nonzero(product >= self._least(reached[own])[:, None])
            found.append((i + k, j))
        return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found]), reached

    def _may(self, off: list[np.ndarray], most: np.ndarray, reached: np.ndarray) -> np.ndarray:
        """Whether a cube that is so far off along the axes may have a place that is good enough."""
        chord2 = sum(o * o for o in off) * (1 - 1e-9)
        if self.weighed:
            return _gravity(most, chord2) >= self._least(reached)
        chord = np.sqrt(np.maximum(0.0, 2 - 2 * reached) + 10 * _PRODUCT) + _ANGLE
        return chord2 <= chord * chord

    def _others(self, own: int, points: np.ndarray, reached: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, pages, what they reach): other pages that may have better places than a query's own."""
        low, high = points.min(axis=0), points.max(axis=0)
        off = np.maximum(0.0, np.maximum(self.corner - high, low - self.corner - self.width))
        near = np.flatnonzero(self._may(list(off.T), self.most, reached.min()))
        near = near[near != own]
        if not len(near):
            return
        if len(points) > 1 and len(points) * len(near) > _PAIRS // 4:
            half = len(points) // 2
            yield from self._others(own, points[:half], reached[:half])
            yield from ((i + half, page, best) for i, page, best in self._others(own, points[half:], reached[half:]))
            return
        reached = np.maximum(reached, self._scores(points @ self.place[near].T, self.most[near]).max(axis=1))
        off = [np.maximum(0.0, np.maximum(self.corner[near, a] - points[:, a, None], points[:, a, None] - self.corner[near, a] - self.width[near, 0])) for a in range(3)]
        i, j = np.nonzero(self._may(off, self.most[near], reached[:, None]))
        yield i, near[j], reached[i]

    def meet(self, others: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """From (qid, _lat, _lon, _page, _reached, row_id, population) of places and queries: a query with each place that may be its best; with others, also a
        query with each page in which it has to look further, row_id null."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            page, held, parts = -1, None, []
            for batch in batches:
                pages = batch.column("_page").to_numpy()
                is_place = batch.column("row_id").is_valid().to_numpy(zero_copy_only=False)
                lat, lon = batch.column("_lat").to_numpy(), batch.column("_lon").to_numpy()
                vectors = _vectors(lat, lon)
                row_id, population, reached = (batch.column(c).fill_null(0).to_numpy() for c in ("row_id", "population", "_reached"))
                turns = np.flatnonzero((np.diff(pages) != 0) | np.diff(is_place)) + 1
                met, further = [], []
                for a, b in zip([0, *turns], [*turns, len(pages)], strict=True):
                    if a == b:
                        continue
                    if pages[a] != page:
                        page, parts, held = pages[a], [], None
                    if is_place[a]:
                        parts.append((vectors[a:b], population[a:b].astype(np.float64), row_id[a:b], population[a:b], lat[a:b], lon[a:b]))
                        held = None
                        continue
                    if held is None:
                        held = [np.concatenate(c) for c in zip(*parts, strict=True)]
                        parts = [held]
                    i, j, best = self._best(vectors[a:b], reached[a:b], held[0], held[1])
                    met.append((i + a, *(c[j] for c in held[2:])))
                    if others:
                        further.extend((i + a, to, best_) for i, to, best_ in self._others(page, vectors[a:b], best))
                yield from _rows(batch, met, further)

        return run


def _rows(batch: pa.RecordBatch, met: list[tuple], further: list[tuple]) -> Iterator[pa.RecordBatch]:
    if not met:
        return
    at, row_id, population, lat, lon = (np.concatenate(c) for c in zip(*met, strict=True))
    n, m = len(at), 0
    to, reached = np.zeros(0, np.int64), np.zeros(0)
    if further:
        i, to, reached = (np.concatenate(c) for c in zip(*further, strict=True))
        at, m = np.concatenate([at, i]), len(i)
    own = batch.select(["qid", "_lat", "_lon"]).take(pa.array(at))
    answer = np.arange(n + m) < n

    def column(values: np.ndarray, kind: pa.DataType, of_answers: bool) -> pa.Array:
        other = np.zeros(m if of_answers else n, values.dtype)
        return pa.array(np.concatenate([values, other] if of_answers else [other, values]), kind, mask=answer != of_answers)

    columns = [column(to, pa.int32(), False), column(reached, pa.float64(), False), column(row_id, pa.int64(), True), column(population, pa.int64(), True), column(lat, pa.float64(), True), column(lon, pa.float64(), True)]
    yield pa.RecordBatch.from_arrays([*own.columns, *columns], ["qid", "_lat", "_lon", "_page", "_reached", "row_id", "population", "_plat", "_plon"])
