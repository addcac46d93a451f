"""License texts found by diagonal voting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.words import ALNUM, grams, slices, text_bytes, words

K = 3
GAP = 3
BLOCK = 1 << 16  # equal rows that one row stands for on the way out
# Phrases that settle a license when their words stand in a row.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
# Opening sentences of public licenses; a span that matches most of one settles it too.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-3": "licensed under the gnu general public license version 3",
    "cc-by-sa": "licensed under the creative commons attribution sharealike license",
    "proprietary": "all rights reserved no part of this publication may be reproduced",
}
# Other spellings of a template's distinguishing words.
SPELLINGS = [
    ("gpl-3", "licensed under the gnu general public license v3"),
    ("gpl-3", "licensed under the gnu general public license either version 3"),
    ("cc-by-sa", "licensed under the creative commons attribution share alike license"),
]
# What sets a template apart from like ones: of the runs of words listed for its label, those that
# it has must stand unbroken in a span. Each has at least ``K`` words.
NEEDED = {
    "mit": ["associated documentation files"],
    "apache-2": ["distributed under the license"],
    "bsd": ["in source and binary forms", "with or without modification", "are permitted provided"],
    "gpl": ["gnu general public license"],
    "gpl-3": ["gnu general public license", "license version 3", "public license v3", "license either version 3"],
    "cc-by-sa": ["creative commons attribution", "commons attribution sharealike", "attribution share alike"],
    "proprietary": ["no part of this"],
}


LISTED = (*TEMPLATES.items(), *SPELLINGS)


def _needed(text: str, runs: list[str]) -> list[int]:
    """The places of a template whose grams a span must have."""
    words, places = text.split(), set()
    for run in map(str.split, runs):
        for at in range(len(words) - len(run) + 1):
            if words[at : at + len(run)] == run:
                places.update(range(at, at + len(run) - K + 1))
    return sorted(places)


def _word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return words(raw, np.array([0, len(raw)]), ALNUM)[3]


def template_grams(spark: SparkSession, templates=LISTED, needed=NEEDED) -> DataFrame:
    """``_gram, _template, _at, _label, _exact, _size, _need``: a row per place in a phrase or template."""
    rows = []
    listed = [(p, label, True) for label, p in PHRASES.items()] + [(t, label, False) for label, t in templates]
    for number, (text, label, exact) in enumerate(listed):
        hashes = _word_hashes(text)
        at, value = grams(hashes, np.zeros(len(hashes), dtype=np.int64), K)
        if len(hashes) < K:
            raise ValueError(f"a template needs at least {K} words: {text!r}")
        need = [] if exact else _needed(text, needed.get(label, []))
        rows += [(v, number, a, label, exact, len(hashes), need) for a, v in zip(at.tolist(), value.view(np.int64).tolist())]
    kinds = "_gram bigint, _template int, _at int, _label string, _exact boolean, _size int, _need array<int>"
    return spark.createDataFrame(rows, kinds)


def rolling_grams(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_key, _hash, _pos, _gram``: every run of ``K`` words of every text.

    A text also has one row at place -1, whose ``_gram`` is its number of words.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                data, offsets = text_bytes(part["_text"])
                _, _, rows, hashes = words(data, offsets, ALNUM)
                n = len(part)
                count = np.bincount(rows, minlength=n)
                at, value = grams(hashes, rows, K)
                first = np.cumsum(count) - count
                row = np.concatenate([np.arange(n), rows[at]])
                pos = np.concatenate([np.full(n, -1), at - first[rows[at]]])
                gram = np.concatenate([count, value.view(np.int64)])
                who = pa.array(row)
                columns = [part["_key"].take(who), part["_hash"].take(who), pa.array(pos), pa.array(gram)]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "_hash", "_pos", "_gram"])

    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_hash"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, _hash bigint, _pos bigint, _gram bigint")


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.6, templates=LISTED, needed=NEEDED
) -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    All word ``K``-grams are joined with the places of the templates, a table of fixed size. A
    match votes for its diagonal, the place in the text less the place in the template.
    Neighbouring diagonals, at most ``GAP`` words inserted or lost apart, are merged into one
    span while they follow each other in text and template. A span is verified by the words of
    the template that its matches cover: all of them on one diagonal for a phrase, the share
    ``least`` for any other template, whose ``NEEDED`` words must be among them. The score is the
    best share.

    ``templates`` are pairs of label and text, in lower case and with a blank between words, of a
    sentence or of a whole license; their grams are broadcast, so the list should stay in the
    thousands. ``needed`` holds, by label, the runs of words that must stand unbroken.

    The result has a row per row of ``docs``. Equal rows, those of one key and content, are scanned
    together and counted, and dealt out again at the end, in blocks of ``BLOCK`` spread over the
    tasks. A null text is empty; a null key is a key like any other.
    """
    table = template_grams(docs.sparkSession, templates, needed)
    marker = F.col("_pos") < 0
    hits = rolling_grams(docs, key, text).withColumn("_join", F.when(~marker, F.col("_gram")))
    # Markers match no template and stay, so texts without any match keep their row.
    hits = hits.join(F.broadcast(table.withColumnRenamed("_gram", "_g")), F.col("_join") == F.col("_g"), "left").where(
        marker | F.col("_g").isNotNull()
    )
    own = ["_key", "_hash"]
    votes = hits.groupBy(*own, "_template", (F.col("_pos") - F.col("_at")).alias("_diagonal")).agg(
        F.max(F.when(marker, F.col("_gram"))).alias("_words"), F.count_if(marker).alias("_copies"),
        F.first("_label").alias("_label"), F.first("_exact").alias("_exact"), F.first("_size").alias("_size"),
        F.first("_need").alias("_need"), F.array_sort(F.collect_set("_at")).alias("_places"),
    )
    reach = [F.array_min("_places").alias("_from"), (F.array_max("_places") + K).alias("_to")]
    votes = votes.select("*", *reach).withColumn("_begin", F.col("_diagonal") + F.col("_from"))
    by_place = Window.partitionBy(*own, "_template").orderBy("_begin", "_diagonal")
    last = F.lag("_diagonal").over(by_place), F.lag("_to").over(by_place)
    follows = (
        ~F.col("_exact")
        & (F.abs(F.col("_diagonal") - last[0]) <= GAP)
        & (F.col("_from") >= last[1] - K)
        & (F.col("_begin") <= last[0] + last[1] + GAP)
    )
    spans = votes.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn(
        "_span", F.sum("_new").over(by_place)
    )
    spans = spans.groupBy(*own, "_template", "_span").agg(
        F.max("_words").alias("_words"), F.max("_copies").alias("_copies"), F.first("_label").alias("_label"), F.first("_exact").alias("_exact"),
        F.first("_size").alias("_size"), F.first("_need").alias("_need"), F.min("_begin").alias("_begin"),
        F.array_distinct(F.flatten(F.collect_list("_places"))).alias("_places"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("_places", lambda p: F.sequence(p, p + (K - 1))))))
    spans = spans.withColumn("_share", F.when(F.col("_label").isNotNull(), covered / F.col("_size")).otherwise(0.0))
    base = F.col("_exact") & (F.col("_share") == 1)
    apart = F.size(F.array_except("_need", "_places")) == 0
    found = base | (~F.col("_exact") & (F.col("_share") >= least) & apart)
    join = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("_label")))), ",")
    scanned = (
        spans.groupBy(*own)
        .agg(
            F.max("_words").alias("n_words"),
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("_begin"))).cast("bigint").alias("first_word"),
            F.max(F.when(base, F.col("_begin"))).cast("bigint").alias("last_word"),
            join(base).alias("base_labels"),
            join(found).alias("labels"),
            F.max("_share").alias("score"),
            F.max("_copies").alias("_copies"),
        )
    )
    # One row stands for at most a block of equal rows before they are spread.
    blocks = scanned.withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr(f"(_copies - 1) div {BLOCK}")))).hint("rebalance")
    inside = F.least(F.lit(BLOCK), F.col("_copies") - F.col("_block") * BLOCK).cast("int")
    rows = blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1), inside)))
    return rows.withColumnRenamed("_key", key).drop("_hash", "_copies", "_block", "_copy")
