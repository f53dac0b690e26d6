"""License scans with a trained paragraph classifier.

Paragraphs (sentences of a line, sentences over line ends and whole stretches of
lines up to a blank one) are classified by multinomial logistic regression on
sparse word bigrams and trigrams into licence families or `unknown`. It is trained
here by numpy gradient descent on the templates below (whole notices, the families'
names in the phrases that introduce them, and SPDX lines), each with words dropped,
changed and surrounded at random, against sentences about other matters and the
same phrases with other names. The unknown class is calibrated on templates that
weren't fitted: one in HELD_OUT of every family's templates and of the other
sentences is left out with all its variants, a temperature is fitted on these, and
the least confidence is set where at most UNKNOWN_RATE of the unknown ones would
pass; then the weights are fitted on all templates.

A prediction counts once a template of the family confirms it: the paragraph has
MIN_MATCH or more of the template's word pairs, has all the words of the template
that tell families apart (MARKS: `lesser`, `affero`, `noncommercial`), and around
these pairs none that the family's templates lack.

No template has MIN_MATCH of its pairs among those of two FUNCTION_WORDS, so a
paragraph without any other pair of a template can't be confirmed and is unknown
without being classified; nothing else is skipped, and texts are read whole.

Edge cases: null and blank texts have no spans; texts of any length are scanned
whole; of families with the same probability the first by name is predicted, and
of overlapping paragraphs the shorter kind counts; repeated rows are scanned like
any other; null identifiers are carried along; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, text_or_empty

#: Names of each family, lower case, without punctuation (fixed texts).
NAMES = {
    "AGPL": ("gnu affero general public license", "gnu affero general public license version 3", "affero general public license", "gnu agpl", "agpl version 3", "agplv3"),
    "Apache": ("apache license version 2 0", "apache license", "apache 2 0 license", "apache license 2 0", "apache lizenz version 2 0", "licencia apache version 2 0", "licence apache version 2 0"),
    "BSD": ("bsd license", "bsd style license", "bsd 2 clause license", "bsd 3 clause license", "new bsd license", "bsd lizenz", "licencia bsd", "licence bsd"),
    "Boost": ("boost software license version 1 0", "boost software license"),
    "CC-BY": ("creative commons attribution 4 0 international license", "creative commons attribution license", "creative commons attribution 3 0 unported license", "cc by 4 0", "cc by"),
    "CC-BY-NC": ("creative commons attribution noncommercial 4 0 international license", "creative commons attribution non commercial license", "cc by nc 4 0", "cc by nc"),
    "CC-BY-NC-ND": ("creative commons attribution noncommercial noderivatives 4 0 international license", "cc by nc nd 4 0", "cc by nc nd"),
    "CC-BY-NC-SA": ("creative commons attribution noncommercial sharealike 4 0 international license", "cc by nc sa 4 0", "cc by nc sa"),
    "CC-BY-ND": ("creative commons attribution noderivatives 4 0 international license", "cc by nd 4 0", "cc by nd"),
    "CC-BY-SA": ("creative commons attribution sharealike 4 0 international license", "creative commons attribution share alike license", "cc by sa 4 0", "cc by sa"),
    "CC0": ("cc0 1 0 universal license", "cc0 1 0", "cc0"),
    "EPL": ("eclipse public license version 2 0", "eclipse public license", "eclipse public license 2 0"),
    "GPL": ("gnu general public license", "gnu general public license version 2", "gnu general public license version 3", "gnu general public license v2 0", "gnu gpl", "gpl", "gpl version 2 or later", "gpl version 3", "gplv2", "gplv3"),
    "ISC": ("isc license",),
    "LGPL": ("gnu lesser general public license", "gnu lesser general public license version 3", "gnu lesser general public license version 2 1", "gnu library general public license", "gnu lgpl", "lgpl"),
    "MIT": ("mit license", "mit lizenz", "licencia mit", "licence mit"),
    "MPL": ("mozilla public license version 2 0", "mozilla public license", "mozilla public license v 2 0", "mpl 2 0"),
}
#: Identifiers in SPDX lines (fixed texts).
SPDX = {
    "AGPL": ("agpl 3 0 only", "agpl 3 0 or later"), "Apache": ("apache 2 0",), "BSD": ("bsd 2 clause", "bsd 3 clause"), "Boost": ("bsl 1 0",),
    "CC-BY": ("cc by 4 0",), "CC-BY-NC": ("cc by nc 4 0",), "CC-BY-NC-ND": ("cc by nc nd 4 0",), "CC-BY-NC-SA": ("cc by nc sa 4 0",), "CC-BY-ND": ("cc by nd 4 0",),
    "CC-BY-SA": ("cc by sa 4 0",), "CC0": ("cc0 1 0",), "EPL": ("epl 2 0",), "GPL": ("gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later"),
    "ISC": ("isc",), "LGPL": ("lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 or later"), "MIT": ("mit",), "MPL": ("mpl 2 0",),
}
#: Phrases that introduce a name.
PHRASES = (
    "licensed under the {}", "licensed under {}", "licensed under a {}", "released under the {}", "distributed under the {}", "distributed under the terms of the {}",
    "this work is licensed under the {}", "this work is licensed under a {}", "this program is licensed under the {}", "subject to the terms of the {}",
    "available under the {}", "made available under the terms of the {}", "published under the {}", "governed by the {}",
    "lizenziert unter der {}", "veröffentlicht unter der {}", "licenciado bajo la {}", "publicado bajo la {}", "sous {}", "publié sous {}",
)
#: Sentences of whole notices, lower case, without punctuation (fixed texts).
NOTICES = {
    "AGPL": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu affero general public license along with this program",
    ),
    "Apache": (
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    "BSD": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "use of this source code is governed by a bsd style license that can be found in the license file",
    ),
    "Boost": (
        "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ),
    "CC0": (
        "dedicated to the public domain under cc0 1 0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    ),
    "EPL": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
        "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
    ),
    "GPL": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "you should have received a copy of the gnu general public license along with this program",
    ),
    "ISC": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "LGPL": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        "redistribute it under the terms of the gnu lesser general public license",
        "you should have received a copy of the gnu lesser general public license along with this library",
    ),
    "MIT": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "MPL": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
    ),
    "Proprietary": (
        "all rights reserved", "all rights reserved no part of this work may be reproduced", "all rights reserved unauthorized copying is prohibited",
        "this document is confidential and proprietary", "alle rechte vorbehalten", "todos los derechos reservados", "tous droits réservés",
    ),
    "Unlicense": (
        "this is free and unencumbered software released into the public domain",
        "spdx license identifier unlicense", "anyone is free to copy modify publish use compile sell or distribute this software",
    ),
}
#: Sentences of no family that share words with the templates, and names that are no licences'.
OTHER = (
    "the license plate of this car is from another state",
    "you may not use this door except in an emergency",
    "she was released from the hospital under the care of a nurse",
    "this work is the best of the year and the next version is due in may",
    "the general public may visit the house on sunday",
    "the source of the river is in the mountains",
    "he got his driving license without any charge",
    "in the summer the apache helicopter was distributed to other units",
    "a copy of this letter was granted to the person in charge",
    "the terms of the contract are subject to change",
    "use of the public library is free for any person",
    "the university is a mit neighbour and part of the state",
    "the author of this book holds a degree in law",
    "the program is on tv and you can watch it or record it",
    "the software is distributed to the schools of the state without fee",
    "all rights of the workers are set out in the contract",
    "the foundation published the list of books this summer",
    "either version of the story is free of any warranty",
    "he sold the source code of the program to the company",
    "permission to enter was granted to any person with a copy of the letter",
    "the above list of conditions was published by the state",
    "the public domain is the part of the land that the state owns",
    "an eclipse of the sun will be seen in the north this year",
    "the new engine gave the car a boost of power",
    "creative people and the commons of the village met under the tree",
    "the mozilla foundation published a report on the general public",
)
OTHER_NAMES = (
    "ministry of health", "terms of the contract", "name of his father", "general public", "bridge", "new law of the state", "title the free house", "counter", "care of a nurse",
    "same conditions as the year before", "rules of the house", "public library", "cover of the night", "old version", "first printing press law",
)
#: Words that tell nothing in pairs of each other (fixed values).
FUNCTION_WORDS = frozenset("a all an and any are as at be been by can for from had has have he her his if in is it its may no not of on one or should so that the their there this to was were which who with without you your".split())
UNKNOWN = "unknown"
#: Variants of a template, and of a family or the other sentences at least.
VARIANTS, LEAST_ROWS, SALADS, EPOCHS, HELD_OUT, UNKNOWN_RATE, MIN_MATCH = 2, 60, 600, 100, 5, 0.005, 0.6
#: Words around the matching pairs of a template that are looked at for other families' marks.
AROUND = 4

_WORD = re.compile(r"[^\W_]+")
#: Lines up to a blank one; ends of sentences and lines; ends of sentences only.
_BLOCK = re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*")
_STOP = re.compile(r"(?<=[.!?])\s+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+|\n+")


def templates() -> dict[str, list[str]]:
    """Each family's texts: notices, names in phrases, SPDX lines."""
    out = {f: list(texts) for f, texts in NOTICES.items()}
    for family, names in NAMES.items():
        out.setdefault(family, []).extend(p.format(n) for n in names for p in PHRASES)
        out[family] += [f"spdx license identifier {n}" for n in SPDX[family]]
    return out


def others() -> list[str]:
    return [*OTHER, *(p.format(n) for n in OTHER_NAMES for p in PHRASES)]


def marks() -> frozenset[str]:
    """Words of names that at most a third of the families have."""
    found: dict[str, set[str]] = {}
    for family, names in NAMES.items():
        for word in {w for n in names for w in n.split()}:
            found.setdefault(word, set()).add(family)
    plain = {"software", "public", "general", "library", "version", "license", "lizenz", "licencia", "licence", "or", "later", "style", "new", "clause", "international", "universal", "unported", "non", "share", "alike", "v"}
    return frozenset(w for w, f in found.items() if 3 * len(f) <= len(NAMES) and w not in plain and not w[0].isdigit())


class Model:
    """Families, vocabulary, feature weights (bigrams, trigrams), calibration."""

    def __init__(self, seed: int = 42):
        draw = np.random.default_rng(seed)
        known = templates()
        self.families = [UNKNOWN, *sorted(known)]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for ts in known.values() for t in ts for w in t.split()}))}
        self.marks = marks()
        self.templates = {f: [(frozenset(zip(t.split(), t.split()[1:])), self.marks & set(t.split())) for t in ts] for f, ts in known.items()}
        self.own_marks = {f: frozenset().union(*(m for _, m in ts)) for f, ts in self.templates.items()}
        self.telling = {p for ts in self.templates.values() for t, _ in ts for p in t if not FUNCTION_WORDS.issuperset(p)}
        if any(len(t - self.telling) >= MIN_MATCH * len(t) for ts in self.templates.values() for t, _ in ts):
            raise ValueError("a template could be confirmed by function words alone")
        texts: list[tuple[list[str], int, bool]] = []
        for k, family in enumerate(self.families):
            own = others() if k == 0 else known[family]
            for number, place in enumerate(draw.permutation(len(own))):
                held = len(own) >= HELD_OUT and number % HELD_OUT == 0
                for v in range(max(VARIANTS, LEAST_ROWS // len(own))):
                    words = own[place].split()
                    if v:  # drop or change words, add others around
                        words = ["" if draw.random() < 0.04 else w for w in words if draw.random() > 0.04]
                        words = [""] * int(draw.integers(0, 4)) + words + [""] * int(draw.integers(0, 4))
                    texts.append((words, k, held))
        bag = list(self.vocabulary)  # word salad of the templates' words
        texts += [([str(w) for w in draw.choice(bag, int(draw.integers(3, 16)))], 0, s % HELD_OUT == 0) for s in range(SALADS)]
        found: dict[tuple[int, ...], int] = {}
        rows = [[found.setdefault(g, len(found)) for g in self.grams([self.vocabulary.get(w, 0) for w in words])] for words, _, _ in texts]
        self.features = found
        y, held = np.array([k for _, k, _ in texts]), np.array([h for _, _, h in texts])
        self.weights, self.bias = self._fit([r for r, h in zip(rows, held) if not h], y[~held])
        self._calibrate(np.array([self.score(r) for r, h in zip(rows, held) if h]), y[held])
        self.weights, self.bias = self._fit(rows, y)

    @staticmethod
    def grams(ids: list[int]) -> list[tuple[int, ...]]:
        """Bigrams and trigrams of known words."""
        two = [g for g in zip(ids, ids[1:]) if all(g)]
        return two + [g for g in zip(ids, ids[1:], ids[2:]) if all(g)]

    def _fit(self, rows: list[list[int]], y: np.ndarray, rate: float = 3.0, ridge: float = 1e-5):
        """Gradient descent with momentum; rows stay sparse: (row, feature) cells, sorted by each."""
        classes, n = len(self.families), len(self.features)
        feature = np.array([f for r in rows for f in r], dtype=np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        order = np.argsort(feature, kind="stable")
        by_feature, used = row[order], np.flatnonzero(np.bincount(feature, minlength=n))
        starts = np.searchsorted(feature[order], used)
        filled, begins = np.unique(row, return_index=True)
        weights, bias, target = np.zeros((n, classes), dtype=np.float32), np.zeros(classes, dtype=np.float32), np.eye(classes, dtype=np.float32)[y]
        weight = 1 / np.bincount(y, minlength=classes).clip(1)[y]
        weight = (weight / weight.sum()).astype(np.float32)
        speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
        for _ in range(EPOCHS):
            score = np.tile(bias, (len(rows), 1))
            score[filled] += np.add.reduceat(weights[feature], begins)
            chance = np.exp(score - score.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            error = (chance - target) * weight[:, None]
            slope = ridge * weights
            slope[used] += np.add.reduceat(error[by_feature], starts)
            speed_w = 0.9 * speed_w - rate * slope
            speed_b = 0.9 * speed_b - rate * error.sum(axis=0)
            weights += speed_w
            bias += speed_b
        bias[0] += 1.0  # without any feature the answer is unknown
        return weights.astype(np.float64), bias.astype(np.float64)

    def score(self, at: list[int]) -> np.ndarray:
        return self.weights[at].sum(axis=0) + self.bias

    def _calibrate(self, scores: np.ndarray, y: np.ndarray) -> None:
        def chances(t):
            e = np.exp((scores - scores.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        def loss(t):
            return -np.log(chances(t)[np.arange(len(y)), y].clip(1e-12)).mean()

        self.temperature = min(np.geomspace(0.1, 4, 49), key=loss)
        unknown = chances(self.temperature)[y == 0][:, 1:].max(axis=1)
        self.least = max(0.5, float(np.quantile(unknown, 1 - UNKNOWN_RATE))) if len(unknown) else 0.5

    def confirmed(self, family: str, words: list[str]) -> float:
        """The largest share of a template's word pairs that the words have, of the family's
        templates that they don't contradict; 0 without any."""
        here, pairs, best = set(words), list(zip(words, words[1:])), 0.0
        every = set(pairs)
        for own, marked in self.templates[family]:
            match = len(own & every) / len(own)
            if match <= best or match < MIN_MATCH or not marked <= here:
                continue
            at = [k for k, p in enumerate(pairs) if p in own]
            around = set(words[max(0, at[0] - AROUND) : at[-1] + 2 + AROUND])
            if (around & self.marks) <= self.own_marks[family]:
                best = match
        return best

    def classify(self, words: list[str]) -> tuple[str, float, float]:
        """(family or unknown, its probability, the template match) of one paragraph."""
        at = [self.features[g] for g in self.grams([self.vocabulary.get(w, 0) for w in words]) if g in self.features]
        score = self.score(at) / self.temperature
        chance = np.exp(score - score.max())
        chance /= chance.sum()
        k = int(chance.argmax())
        if k == 0 or chance[k] < self.least:
            return UNKNOWN, float(chance[0]), 0.0
        match = self.confirmed(self.families[k], words)
        return (self.families[k] if match >= MIN_MATCH else UNKNOWN), float(chance[k]), match


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of this process: it depends on the texts above and its seed alone."""
    return Model()


def _pieces(text: str, telling: set[tuple[str, str]]):
    """For every stretch of lines up to a blank one with a telling pair (start, end) of the
    sentences of its lines, of its sentences over line ends, and its own."""
    for block in _BLOCK.finditer(text):
        words = _WORD.findall(block.group().lower())
        if telling.isdisjoint(zip(words, words[1:])):
            continue
        low, high = block.span()
        single = list(_cuts(_SENTENCE, text, low, high))
        wrapped = [p for p in _cuts(_STOP, text, low, high) if p not in single] if "\n" in block.group() else []
        yield single, wrapped, [(low, high)] if "\n" in block.group() and (low, high) not in wrapped else []


def _cuts(pattern: re.Pattern, text: str, low: int, high: int):
    at = low
    for cut in pattern.finditer(text, low, high):
        yield at, cut.start()
        at = cut.end()
    yield at, high


def spans(text: str, own: Model) -> list[tuple[int, int, str, float, float]]:
    """(start, length, family, score, match) of the confirmed paragraphs of a text.
    Sentences of a line come first. A sentence over line ends counts where none of them
    was confirmed inside it, or where those are of its family and match less; a whole
    stretch of lines counts where nothing was confirmed inside it."""
    out, telling = [], own.telling

    def found(at: int, end: int):
        words = _WORD.findall(text[at:end].lower())
        if not telling.isdisjoint(zip(words, words[1:])):
            family, score, match = own.classify(words)
            if family != UNKNOWN:
                return at, end - at, family, score, match
        return None

    for single, wrapped, whole in _pieces(text, telling):
        here = [s for at, end in single if (s := found(at, end))]
        for at, end in wrapped:
            inside = [s for s in here if at < s[0] + s[1] and s[0] < end]
            if (s := found(at, end)) and all(i[2] == s[2] and i[4] < s[4] and at <= i[0] and i[0] + i[1] <= end for i in inside):
                here = [h for h in here if h not in inside] + [s]
        if not here:
            here = [s for at, end in whole if (s := found(at, end))]
        out += sorted(here)
    return out


_NAMES = ("start", "length", "family", "score", "match")
_SPANS = pa.list_(pa.struct(list(zip(_NAMES, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (start and length in characters, family, score, match) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            found = [[dict(zip(_NAMES, s)) for s in spans(t, shared.value)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPANS)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, spans array<struct<start:bigint,length:bigint,family:string,score:double,match:double>>")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document with its licence families and spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["family"]))), ",")
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"), s["family"])), ",")
    return found.select("doc_id", F.size("spans").cast("bigint").alias("n_spans"), families.alias("families"), places.alias("places"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("best_score"))


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES: dict[str, str] = {}
