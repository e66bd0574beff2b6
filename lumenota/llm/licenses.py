"""License scans: MinHash bands over overlapping text windows retrieve templates.

A template is compared with windows of about its own length: for each size class of templates the
texts are cut into overlapping windows, a short stride apart, so that some window holds a copy whole
and little else. A window's bands (one MinHash each) are looked up among the templates'; their
number makes a copy collide with at least CERTAINTY. A hit is verified by exact containment of the
template's distinct shingles in the window.

Templates are a short list given by the caller and travel with the task (LARGEST_TEMPLATES words at
most in total). Words are compared in lower case without punctuation at their ends; shingles have
five words, or all words of a shorter template.

Defined cases: null and blank texts hold nothing; texts are read whole at any length; of several
windows that hold one template each is a finding, overlapping ones are merged; repeated rows are
scanned alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.llm.common import slices, table

WORDS = 5
THRESHOLD = 0.8
#: A copy collides in some band with at least this probability.
CERTAINTY = 0.9999
LARGEST_TEMPLATES = 200_000
_TURN = 4 << 20

#: Notices that name a license, as they are commonly written (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at"
    ),
    "MIT": "Released under the MIT License",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version"
    ),
    "BSD-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
}

_U = np.uint64
_EDGE = b".,;:!?()[]{}\"'`*"


class Template(NamedTuple):
    name: str
    width: int
    shingles: np.ndarray


class SizeClass(NamedTuple):
    """Templates of one shingle width and similar size, with the minima of their hash functions.

    Windows hold ``blocks`` strides of shingles; ``minima`` has, for each function, the sorted
    least values of the templates and whose they are.
    """

    width: int
    stride: int
    blocks: int
    templates: list[Template]
    minima: list[tuple[np.ndarray, np.ndarray]]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def _word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of normalised words; each spelling is hashed once a turn."""
    import xxhash

    def make(word: bytes) -> int:
        plain = word.decode("utf-8", "replace").lower().encode().strip(_EDGE)
        return known.setdefault(word, xxhash.xxh64_intdigest(plain))

    return np.array([known[w] if w in known else make(w) for w in words], np.uint64)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, width):
        h = h * _U(0xD6E8FEB86659FD93) + words[j : n + j]
    return _mixed(h)


def _values(shingles: np.ndarray, k: int) -> np.ndarray:
    """Hash function k of shingles; those that are no shingle (zero) come last."""
    seed = _U((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return np.where(shingles == 0, ~_U(0), (shingles ^ seed) * _U(0xD6E8FEB86659FD93))


def size_classes(templates: dict[str, str]) -> list[SizeClass]:
    """Templates by shingle width and octave of their number of shingles.

    A window as long as the largest template and a stride holds any copy whole. A template of n
    shingles, THRESHOLD of them in the window, then has at least ``similarity`` with it, and as many
    one-row bands are taken as miss it with less than 1 - CERTAINTY.
    """
    rows = []
    for name, text in templates.items():
        words = _word_hashes(text.encode().split(), {})
        if len(words):
            width = min(WORDS, len(words))
            rows.append(Template(name, width, np.unique(_shingles(words, width))))
    if sum(len(t.shingles) for t in rows) > LARGEST_TEMPLATES:
        raise ValueError("the templates are too many to travel with each task")
    classes: dict[tuple[int, int], list[Template]] = {}
    for t in rows:
        classes.setdefault((t.width, len(t.shingles).bit_length()), []).append(t)
    out = []
    for (width, _), some in sorted(classes.items()):
        least, most = min(len(t.shingles) for t in some), max(len(t.shingles) for t in some)
        stride = max(1, most // 8)
        blocks = ceil((most + stride - 1) / stride)
        inside = ceil(THRESHOLD * least)
        similarity = inside / (blocks * stride + least - inside)
        bands = 1 if similarity >= 1 else ceil(log(1 - CERTAINTY) / log(1 - similarity))
        minima = []
        for k in range(bands):
            values = np.array([_values(t.shingles, k).min() for t in some])
            order = np.argsort(values)
            minima.append((values[order], order))
        out.append(SizeClass(width, stride, blocks, some, minima))
    return out


def _window_minima(values: np.ndarray, stride: int, blocks: int) -> np.ndarray:
    """Least value of each window of ``blocks`` strides, one stride apart, by doubling."""
    least = values if stride == 1 else np.minimum.reduceat(values, np.arange(0, len(values), stride))
    least = np.append(least, np.full(blocks - 1, ~_U(0)))
    span = 1
    while span < blocks:
        step = min(span, blocks - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least


def _findings(words: np.ndarray, doc: np.ndarray, classes: list[SizeClass]) -> list[tuple]:
    """(text, template, first word, end, containment) of the templates that texts hold.

    ``words`` are those of several texts one after the other, ``doc`` tells whose they are.
    """
    out = []
    begins = np.searchsorted(doc, np.arange(doc[-1] + 1)) if len(doc) else doc
    for c in classes:
        shingles = _shingles(words, c.width)
        n = len(shingles)
        if not n:
            continue
        shingles[doc[:n] != doc[c.width - 1 :]] = 0
        hits = []
        for k, (values, owners) in enumerate(c.minima):
            found = _window_minima(_values(shingles, k), c.stride, c.blocks)
            at = np.searchsorted(values, found).clip(max=len(values) - 1)
            window = np.flatnonzero(values[at] == found)
            for place in range(len(values)):  # templates that share a least value
                own = window[values[place] == found[window]]
                hits.append(np.stack([own, np.full(len(own), owners[place])], axis=1))
        for window, owner in np.unique(np.concatenate(hits), axis=0).tolist():
            t = c.templates[owner]
            low = window * c.stride
            near = shingles[low : low + c.blocks * c.stride]
            inside = low + np.flatnonzero(np.isin(near, t.shingles))
            for text in np.unique(doc[inside]).tolist():
                own = inside[doc[inside] == text]
                held = len(np.unique(shingles[own])) / len(t.shingles)
                if held >= THRESHOLD:
                    first = int(own[0] - begins[text])
                    last = int(own[-1] - begins[text]) + c.width
                    out.append((text, t.name, first, last, held))
    return _merged(out)


def _merged(found: list[tuple]) -> list[tuple]:
    """Overlapping findings of one template in one text become one."""
    out: list[tuple] = []
    for text, name, first, last, held in sorted(set(found)):
        if out and out[-1][:2] == (text, name) and first < out[-1][3]:
            _, _, a, b, best = out[-1]
            out[-1] = (text, name, a, max(b, last), max(best, held))
        else:
            out.append((text, name, first, last, held))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per finding: doc_id, template, first_word, end_word and containment."""
    classes = size_classes(TEMPLATES if templates is None else templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for begin, texts in slices(batch.column("text"), _TURN):
                known: dict[bytes, int] = {}
                split = [text.split() for text in texts]
                words = _word_hashes([w for some in split for w in some], known)
                doc = np.repeat(np.arange(len(split)), [len(some) for some in split])
                rows = [(begin + i, *rest) for i, *rest in _findings(words, doc, classes)]
                at, names, first, last, held = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at, pa.int64())), pa.array(names, pa.string()),
                     pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                     pa.array(held, pa.float64())],
                    names=["doc_id", "template", "first_word", "end_word", "containment"],
                )

    number = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(number, "text").mapInArrow(
        scan, "doc_id long, template string, first_word long, end_word long, containment double"
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
