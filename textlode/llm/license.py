"""License scan by a positional index of rare words.

Method.  Templates (short phrases and whole notices) are split into words.  The document frequency of every template word is counted over all
documents; each template is posted, with its positions, under its words of highest IDF (``anchors`` of them, one for a phrase).  In a document only
words that are posted are looked up; each gives, for every posting (template, position), the place where the template would start.  Starts on which
enough of a template's anchors agree are intersected into candidates.  A phrase candidate counts if all its words stand there; a notice candidate
is aligned by relative position within ``slack`` words, needs its mandatory key phrase inside the aligned span, and scores the share of its words found.

The phrase anchor occurs in every occurrence of a phrase, so phrases are found everywhere, exactly.  Notices are the method's own labels.

The index has a fixed size (the templates); documents are read twice (frequencies, scan) and never shuffled; only word counts are.

Defined cases: a null or empty text has no words, no label and score 0; repeated rows give repeated rows; an empty table gives an empty table (and
IDFs of an empty corpus, all alike); extra columns are ignored.  Ties in IDF go to the earlier word of the template.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared, words as W

#: The phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices that are recognised besides: label, mandatory key phrase, words of the notice.
NOTICES = (
    ("mit-notice", "permission is hereby granted",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the "
     "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("apache-notice", "apache license",
     "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache-short", "apache license", "licensed under the apache license version 2 0"),
    ("gpl-notice", "general public license",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
     "software foundation either version 3 of the license or at your option any later version"),
    ("gpl-short", "general public license", "licensed under the gnu general public license version 3"),
    ("mit-short", "mit license", "released under the mit license"),
    ("bsd-notice", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-notice", "mozilla public license",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-short", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("spdx", "spdx license identifier", "spdx license identifier"),
)


def _hashes(text: str) -> np.ndarray:
    return next(W.words_by_text([text.encode()], W.ALNUM))[1]


def document_frequencies(docs: DataFrame, words: list[str], text_col="text") -> tuple[int, dict[str, int]]:
    """(rows, documents that hold each of ``words``) over all of ``docs``; one row of counts per task is shuffled."""
    keys = np.concatenate([_hashes(w) for w in words])
    order = np.argsort(keys)
    ranked = keys[order]

    def count(batches):
        found, rows = np.zeros(len(keys), dtype=np.int64), 0
        for b in batches:
            for _, hashes, cuts, *_ in W.words_by_text(b.column(0), W.ALNUM):
                at = np.searchsorted(ranked, hashes)
                at[at == len(ranked)] = 0
                hit = np.flatnonzero(ranked[at] == hashes)
                doc = np.searchsorted(cuts, hit, side="right") - 1
                pairs = np.unique(doc * len(keys) + at[hit])
                found += np.bincount(pairs % len(keys), minlength=len(keys))
                rows += len(cuts) - 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(keys))], pa.int32()), pa.array([rows, *found.tolist()], pa.int64())], names=["w", "n"])

    total = {r["w"]: r["n"] for r in docs.select(text_col).transform(shared.in_batches, count, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return total.get(-1, 0), {words[order[i]]: total.get(i, 0) for i in range(len(keys))}


class Index:
    """Postings of the templates' anchors, and all template words for verification."""

    def __init__(self, phrases, notices, rows, frequency, anchors):
        self.labels, self.words, self.keys, self.needed, self.exact = [], [], [], [], []
        postings: dict[int, list[tuple[int, int]]] = {}
        entries = [(label, phrase, phrase, True) for phrase, label in phrases.items()] + [(n, key, text, False) for n, key, text in notices]
        for t, (label, key, text, exact) in enumerate(entries):
            own = text.split()
            idf = [-np.log((1 + frequency.get(w, 0)) / (1 + rows)) for w in own]
            best = sorted(range(len(own)), key=lambda i: (-idf[i], i))[:1 if exact else anchors]
            hashes = _hashes(text)
            for i in best:
                postings.setdefault(int(hashes[i]), []).append((t, i))
            self.labels.append(label)
            self.words.append(hashes)
            self.keys.append(_hashes(key))
            self.exact.append(exact)
            self.needed.append(1 if exact else max(1, len(best) // 2))
        self.posted = np.array(sorted(postings), dtype=np.uint64)
        self.postings = [postings[int(h)] for h in self.posted]


def scan_words(hashes: np.ndarray, index: Index, slack=4, least=0.6):
    """Of one document: ({phrase template: starts}, {notice label: score})."""
    starts: dict[int, list[np.ndarray]] = {}
    if len(hashes):
        at = np.searchsorted(index.posted, hashes)
        at[at == len(index.posted)] = 0
        places = np.flatnonzero(index.posted[at] == hashes)
        for p in np.unique(at[places]):
            own = places[at[places] == p]
            for t, i in index.postings[p]:
                starts.setdefault(t, []).append(own - i)
    base, scores = {}, {}
    for t, found in starts.items():
        template = index.words[t]
        n = len(template)
        if index.exact[t]:
            s = found[0]
            s = s[(s >= 0) & (s + n <= len(hashes))]
            for j in range(n):
                s = s[hashes[s + j] == template[j]]
            if len(s):
                base[t] = s
            continue
        s = np.sort(np.concatenate(found))
        k = index.needed[t]
        close = s[:len(s) - k + 1][s[k - 1:] - s[:len(s) - k + 1] <= slack] if len(s) >= k else s[:0]
        for start in np.unique(close):
            lo, hi = max(0, start - slack), min(len(hashes), start + n + 2 * slack)
            span = hashes[lo:hi]
            key = index.keys[t]
            grams = W.grams(span, len(key))
            if not len(grams) or not (grams == W.grams(key, len(key))[0]).any():
                continue  # the mandatory phrase is missing
            share = np.isin(template, span).mean()
            if share >= least:
                scores[index.labels[t]] = max(scores.get(index.labels[t], 0.0), float(share))
    return base, scores


def scan(docs: DataFrame, id_col="doc_id", text_col="text", phrases=None, notices=NOTICES, anchors=6, slack=4, least=0.6) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, and ``places`` (label and start word of each phrase).

    score is 1 with a phrase, else the best notice's share of words found, else 0.
    """
    phrases = PHRASES if phrases is None else phrases
    vocabulary = sorted({w for text in [*phrases, *(n[2] for n in notices)] for w in text.split()})
    index = Index(phrases, notices, *document_frequencies(docs, vocabulary, text_col), anchors)
    kind = docs.schema[id_col].dataType.simpleString()
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])

    def run(batches):
        for b in batches:
            rows = []
            for _, hashes, cuts, *_ in W.words_by_text(b.column(1), W.ALNUM):
                for i in range(len(cuts) - 1):
                    own = hashes[cuts[i]:cuts[i + 1]]
                    base, scores = scan_words(own, index, slack, least)
                    where = sorted((int(s), index.labels[t]) for t, found in base.items() for s in found)
                    labels = {label for _, label in where}
                    rows.append((len(own), len(where), where[0][0] if where else None, where[-1][0] if where else None, ",".join(sorted(labels)),
                                 ",".join(sorted(labels | set(scores))), 1.0 if where else max(scores.values(), default=0.0),
                                 [{"label": label, "word": s} for s, label in where]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(place))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    return docs.select(F.col(id_col).alias("id"), text_col).transform(shared.in_batches, 
        run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
             "places array<struct<label:string,word:bigint>>").withColumnRenamed("id", id_col)
