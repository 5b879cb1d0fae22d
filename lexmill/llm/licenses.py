"""License scans by diagonal voting, with joins and grouping only.

Every run of three words of every text joins the places where the templates have
the same run; each match votes for a diagonal (place in the text less place in the
template). A diagonal with all votes of a template is a verbatim copy of it; the
words themselves are compared in the join, beside their hashes. Diagonals that
lie next to each other are one span with words put in or left out.

Spans are verified: enough of the template's runs must be there, all runs of the
words that tell its license from others, and the span may not be much longer than
the template. Where verified spans of several templates lie over each other, each
place goes to the one with most runs, and a span that keeps less than half of its
places gives no label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexmill.llm.shared import LOWER, UPPER, kept, row_key, whole_text

#: What stands between words here: ASCII other than digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals at most so many words apart are neighbours.
NEIGHBOURS = 3
#: Share of a template's runs that a span of neighbouring diagonals must have.
COVERAGE = 0.6
#: A span may have this many times the template's words.
MOST_STRETCH = 2

# The phrases whose places are counted, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Notices of licenses in common use, their labels, and the words in them that name the license.
NOTICES = (
    ("released under the mit license", "mit", "the mit license"),
    ("licensed under the mit license", "mit", "the mit license"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"
        " files the software to deal in the software without restriction including without limitation the rights to use copy modify"
        " merge publish distribute sublicense and or sell copies of the software",
        "mit",
        "",
    ),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", ""),
    (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties"
        " of merchantability fitness for a particular purpose and noninfringement",
        "mit",
        "",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided"
        " that the above copyright notice and this permission notice appear in all copies",
        "isc",
        "",
    ),
    ("licensed under the apache license version 2 0", "apache-2", "apache license version 2"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "apache-2",
        "apache license version 2",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ""),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
        " from this software without specific prior written permission",
        "bsd-3",
        "",
    ),
    (
        "you can redistribute it and or modify it under the terms of the gnu general public license",
        "gpl",
        "the gnu general public license",
    ),
    (
        "gnu general public license as published by the free software foundation either version 2 of the license",
        "gpl-2",
        "version 2 of the license",
    ),
    (
        "gnu general public license as published by the free software foundation either version 3 of the license",
        "gpl-3",
        "version 3 of the license",
    ),
    ("gnu general public license version 2", "gpl-2", "gnu general public license version 2"),
    ("gnu general public license version 3", "gpl-3", "gnu general public license version 3"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3", "gnu general public license version 3"),
    ("gnu lesser general public license", "lgpl", "gnu lesser general public license"),
    (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "lgpl",
        "gnu lesser general public license",
    ),
    ("gnu library general public license", "lgpl", "gnu library general public license"),
    ("gnu affero general public license", "agpl", "gnu affero general public license"),
    (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license",
        "agpl",
        "gnu affero general public license",
    ),
    ("mozilla public license version 2 0", "mpl-2", "public license version 2 0"),
    ("mozilla public license 2 0", "mpl-2", "mozilla public license 2 0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", "mozilla public license v 2 0"),
    ("this is free and unencumbered software released into the public domain", "unlicense", ""),
    ("licensed under cc by 4 0", "cc-by", "cc by 4"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa 4"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc 4"),
    ("licensed under cc by nd 4 0", "cc-by-nd", "cc by nd 4"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa", "cc by nc sa 4"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd", "cc by nc nd 4"),
    ("creative commons attribution 4 0 international", "cc-by", "commons attribution 4 0"),
    ("creative commons attribution sharealike 4 0 international", "cc-by-sa", "commons attribution sharealike 4 0"),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc", "commons attribution noncommercial 4 0"),
    ("creative commons attribution noderivatives 4 0 international", "cc-by-nd", "commons attribution noderivatives 4 0"),
    (
        "creative commons attribution noncommercial sharealike 4 0 international",
        "cc-by-nc-sa",
        "commons attribution noncommercial sharealike 4 0",
    ),
    ("cc0 1 0 universal", "cc0", "cc0 1 0"),
    ("spdx license identifier mit", "mit", "license identifier mit"),
    ("spdx license identifier isc", "isc", "license identifier isc"),
    ("spdx license identifier unlicense", "unlicense", "license identifier unlicense"),
    ("spdx license identifier apache 2 0", "apache-2", "identifier apache 2 0"),
    ("spdx license identifier mpl 2 0", "mpl-2", "identifier mpl 2 0"),
    ("spdx license identifier gpl 2 0", "gpl-2", "identifier gpl 2 0"),
    ("spdx license identifier gpl 3 0", "gpl-3", "identifier gpl 3 0"),
    ("spdx license identifier lgpl 2 1", "lgpl", "identifier lgpl 2 1"),
    ("spdx license identifier lgpl 3 0", "lgpl", "identifier lgpl 3 0"),
    ("spdx license identifier agpl 3 0", "agpl", "identifier agpl 3 0"),
    ("spdx license identifier bsd 2 clause", "bsd", "identifier bsd 2 clause"),
    ("spdx license identifier bsd 3 clause", "bsd-3", "identifier bsd 3 clause"),
    ("spdx license identifier cc0 1 0", "cc0", "identifier cc0 1 0"),
)


def template_runs(notices=NOTICES) -> list[tuple]:
    """(text, label, base, names): ``names`` are the places of the runs that a span must have."""
    listed = [(text, label, True, []) for text, label in PHRASES]
    for text, label, name in notices:
        split, named = text.split(), name.split()
        at = next(i for i in range(len(split)) if split[i : i + len(named)] == named)
        listed.append((text, label, False, list(range(at, at + len(named) - GRAM + 1)) if named else []))
    return listed


def templates(spark: SparkSession, notices=NOTICES) -> DataFrame:
    """One row per run of a template: template, label, base, grams, names, tpos, gram, gram_hash. A fixed, small table."""
    rows = F.array(
        *[
            F.struct(
                F.lit(text).alias("text"),
                F.lit(label).alias("label"),
                F.lit(base).alias("base"),
                F.array(*map(F.lit, names)).cast("array<int>").alias("names"),
            )
            for text, label, base, names in template_runs(notices)
        ]
    )
    one = spark.range(1).select(F.posexplode(rows).alias("template", "t"))
    split = one.select("template", "t.label", "t.base", "t.names", F.split("t.text", " ").alias("w"))
    return split.select(
        "template",
        "label",
        "base",
        (F.size("w") - (GRAM - 1)).alias("grams"),
        "names",
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - (GRAM - 1)), lambda i: F.array_join(F.slice("w", i, GRAM), " "))).alias("tpos", "gram"),
    ).withColumn("gram_hash", F.xxhash64("gram"))


def license_votes(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """(doc_id, row_key, template, label, base, grams, names, diagonal, runs): the template's runs found on each diagonal."""
    split = docs.select(
        "doc_id", row_key().alias("row_key"), F.array_remove(F.split(F.translate(whole_text(), UPPER, LOWER), BETWEEN), "").alias("w")
    ).where(F.size("w") >= GRAM)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (GRAM - 1)), lambda i: F.array_join(F.slice("w", i, GRAM), " "))
    grams = split.select("doc_id", "row_key", F.posexplode(runs).alias("pos", "gram")).withColumn("gram_hash", F.xxhash64("gram"))
    known = F.broadcast(templates(docs.sparkSession, notices))
    return (
        grams.join(known, ["gram_hash", "gram"])
        .groupBy("doc_id", "row_key", "template", "label", "base", "grams", "names", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.collect_set("tpos").alias("runs"))
    )


def license_spans(votes: DataFrame) -> DataFrame:
    """One row per span: its runs, places and share, how often it holds the template verbatim, and whether it is verified."""
    along = Window.partitionBy("doc_id", "row_key", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    places = F.transform("runs", lambda run: F.col("diagonal") + run)
    spans = (
        votes.withColumn("opens", F.when(step <= NEIGHBOURS, 0).otherwise(1))
        .withColumn("span", F.sum("opens").over(along))
        .groupBy("doc_id", "row_key", "template", "label", "base", "grams", "names", "span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"),
            F.array_distinct(F.flatten(F.collect_list(places))).alias("places"),
            F.sum((F.size("runs") == F.col("grams")).cast("long")).alias("verbatim"),
            F.min(F.when(F.size("runs") == F.col("grams"), F.col("diagonal"))).alias("first_at"),
            F.max(F.when(F.size("runs") == F.col("grams"), F.col("diagonal"))).alias("last_at"),
        )
        .withColumn("covered", F.size("runs"))
        .withColumn("share", F.col("covered") / F.col("grams"))
    )
    named = F.size(F.array_except("names", "runs")) == 0
    # Words of the text from the span's first run to its last; a span of several copies may have that many times more.
    extent = F.array_max("places") - F.array_min("places") + GRAM
    room = (F.col("grams") + (GRAM - 1)) * MOST_STRETCH * F.greatest(F.col("verbatim"), F.lit(1))
    return spans.withColumn("verified", (F.col("share") >= COVERAGE) & named & (extent <= room))


def winning_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, row_key, label) of the verified spans of notices that keep half of their places or more.

    A place of the text has one row per template at most, so no group grows with a text.
    """
    own = spans.where(~F.col("base") & F.col("verified"))
    each = own.select("doc_id", "row_key", "template", "span", "label", "covered", F.explode("places").alias("place"))
    best = Window.partitionBy("doc_id", "row_key", "place").orderBy(F.desc("covered"), "template")
    most = F.first("label").over(best)
    kept_places = each.withColumn("won", (F.col("label") == most).cast("int"))
    by_span = kept_places.groupBy("doc_id", "row_key", "template", "span", "label").agg(F.avg("won").alias("won"))
    return by_span.where(F.col("won") >= 0.5).select("doc_id", "row_key", "label").distinct()


def scan(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    ``n_base`` counts all places of the base phrases, ``score`` is the largest share
    of a template's runs in one span (0 without any). Null and empty texts have no
    words and no labels (empty strings). Rows that share an id are scanned one by
    one, repeated rows come out repeated, null ids are kept. An empty table gives an
    empty result. Further columns are not read.
    """
    spans = kept(license_spans(kept(license_votes(docs, notices), "license-votes")), "license-spans")
    is_base = F.col("base") & (F.col("verbatim") > 0)
    base = spans.groupBy("doc_id", "row_key").agg(
        F.sum(F.when(is_base, F.col("verbatim")).otherwise(0)).alias("n_base"),
        F.min(F.when(is_base, F.col("first_at"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("last_at"))).cast("long").alias("last_word"),
        F.max("share").alias("score"),
        F.collect_set(F.when(is_base, F.col("label"))).alias("base_set"),
    )
    own = winning_spans(spans).groupBy("doc_id", "row_key").agg(F.collect_set("label").alias("own_set"))
    same = F.col("b.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("b.row_key") == F.col("o.row_key"))
    none = F.array().cast("array<string>")
    both = F.array_union("base_set", F.coalesce("own_set", none))
    found = base.alias("b").join(own.alias("o"), same, "left").select(
        "b.doc_id", "b.row_key", "n_base", "first_word", "last_word", "score",
        F.array_join(F.sort_array("base_set"), ",").alias("base_labels"),
        F.array_join(F.sort_array(both), ",").alias("labels"),
    )
    w = F.array_remove(F.split(F.translate(whole_text(), UPPER, LOWER), BETWEEN), "")
    rows = docs.select("doc_id", row_key().alias("row_key"), F.size(w).cast("long").alias("n_words"))
    matched = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.row_key") == F.col("f.row_key"))
    return (
        rows.alias("r")
        .join(found.alias("f"), matched, "left")
        .select(
            "r.doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            "first_word",
            "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
        )
    )
