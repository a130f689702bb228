"""License scan by a positional index of rare licence words, in Spark expressions and joins only.

A template is a sequence of words with mandatory key phrases.  Document frequencies of all template words
are counted over all documents; each template is looked up by the highest-IDF word of its key phrases.  An
occurrence of that word in a file proposes one alignment of the template; the postings of the template's
other words are then intersected with the file's by relative position, and an alignment stands if every word
of every key phrase is in place and enough of the template is.  As key phrases are mandatory, looking up one
of their words finds every alignment that can stand.

Texts are read once.  That pass cuts each into words, counts them and notes which template words occur; only a
text that has every word of some template's key phrases notes where.  What it writes has no texts: frequencies,
anchors and alignments come from there, keyed by the SHA-256 of the text, so copies are aligned once.

Defined results: null, empty and wordless texts have no words, places or labels and score 0; the score is the
largest share of a template's words in place among standing alignments; repeated rows get equal results; an empty
table gives no rows; a very long text takes time in proportion to its words; columns other than id and text are
not read, and the id may have any name.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.llm.common import lower_ascii, sized_broadcast, stage

#: Share of a template's words that must be in place.
LEAST_SHARE = 0.6


class Template(NamedTuple):
    label: str
    words: str
    keys: tuple[str, ...]
    #: One of the plain phrases whose places are reported.
    base: bool = False


# Phrases and notices as licences word them.
BASE = tuple(
    Template(label, phrase, (phrase,), base=True)
    for phrase, label in (
        ("gnu general public license", "gpl"),
        ("apache license", "apache"),
        ("cc by", "cc-by"),
        ("mit license", "mit"),
    )
)
MORE = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "purpose with or without fee")),
    Template("apache", "licensed under the apache license version 2 0", ("licensed under the apache license",)),
    Template("gpl", "licensed under the gnu general public license version", ("gnu general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted free of charge", "without limitation the rights to use copy modify")),
    Template("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("licensed under the apache license", "except in compliance with the license")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("under the terms of the gnu general public license",)),
    Template("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    Template("mpl", "mozilla public license", ("mozilla public license",)),
    Template("epl", "eclipse public license", ("eclipse public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
TEMPLATES = BASE + MORE


#: Every ASCII character that is in no word, one by one: the regular expression then looks each up in a table.
_BETWEEN = "[" + "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum()) + "]+"


def words(text: Column) -> Column:
    """Words of a text whose letters were lowered before; case does not change where they begin and end."""
    return F.array_remove(F.split(text, _BETWEEN, -1), "")


def key_words(t: Template) -> set[int]:
    """Places of a template's words that are in its key phrases."""
    own, key = t.words.split(), set()
    for phrase in t.keys:
        part = phrase.split()
        starts = [i for i in range(len(own)) if own[i : i + len(part)] == part]
        if not starts:
            raise ValueError(f"the key phrase {phrase!r} is not in the template {t.words!r}")
        key.update(starts[0] + i for i in range(len(part)))
    return key


def postings(spark: SparkSession, templates: tuple[Template, ...], seen: dict[str, int]) -> DataFrame:
    """(template, offset, word, is_key, is_anchor): the library, a parameter of fixed size."""
    rows = []
    for number, t in enumerate(templates):
        own, key = t.words.split(), key_words(t)
        anchor = min(key, key=lambda i: (seen.get(own[i], 0), i))
        rows += [(number, i, w, i in key, i == anchor) for i, w in enumerate(own)]
    return spark.createDataFrame(rows, "template int, offset int, word string, is_key boolean, is_anchor boolean")


def indexed(docs: DataFrame, id: str, text: str, templates: tuple[Template, ...]) -> DataFrame:
    """A written table: _id, key, n_words, the template words found, and where (pos, word) if any template can stand."""
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # Lowering beyond ASCII keeps every border of a word and every word of ASCII letters, and is much faster.
    every = words(F.lower(body))
    rows = docs.select(
        F.col(f"`{id}`").alias("_id"), F.unhex(F.sha2(body, 256)).alias("key"), body.alias("_text"),
        F.size(every).cast("long").alias("n_words"),
        F.array_intersect(every, F.lit(vocabulary)).alias("found"),
    )
    keys = {tuple(sorted({t.words.split()[i] for i in key_words(t)})) for t in templates}
    can_stand = [F.forall(F.lit(list(k)), lambda w: F.array_contains("found", w)) for k in sorted(keys)]
    placed = F.transform(words(lower_ascii(F.col("_text"))), lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    hits = F.filter(placed, lambda h: h["word"].isin(vocabulary))
    rows = rows.withColumn("hits", F.when(reduce(or_, can_stand), hits))
    return stage(rows.drop("_text"), "licence-words")


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST_SHARE) -> DataFrame:
    """Per row of ``docs``: id, n_words, and the alignments that stand (template, start, share) as places."""
    rows = indexed(docs, id, text, templates)
    # Over all documents; one number per template word comes to the driver.
    seen = {r[0]: r[1] for r in rows.select(F.explode("found").alias("word")).groupBy("word").count().collect()}
    index = postings(docs.sparkSession, templates, seen)
    files = rows.where(F.col("hits").isNotNull()).select("key", "hits")
    files = files.groupBy("key").agg(F.first("hits").alias("hits"))
    hits = stage(files.select("key", F.explode("hits").alias("h")).select("key", "h.pos", "h.word"), "licence-hits")

    small = F.broadcast(index)  # as large as the template library
    proposed = hits.join(small.where("is_anchor"), "word").select(
        "key", "template", (F.col("pos") - F.col("offset")).alias("start")
    )
    expected = proposed.join(small, "template").select(
        "key", "template", "start", "is_key", "word", (F.col("start") + F.col("offset")).alias("pos")
    )
    in_place = expected.join(hits, ["key", "pos", "word"]).groupBy("key", "template", "start")
    sizes = F.array(*(F.lit(len(t.words.split())) for t in templates))
    keys = F.array(*(F.lit(len(key_words(t))) for t in templates))
    stand = (
        in_place.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_key").cast("int")).alias("n_key"))
        .where(F.col("n_key") == keys[F.col("template")])
        .withColumn("share", F.col("n") / sizes[F.col("template")])
        .where(F.col("share") >= least)
    )
    places = F.sort_array(F.collect_list(F.struct("start", "template", "share"))).alias("places")
    by_text = stage(stand.groupBy("key").agg(places), "licence-places")
    joined = rows.join(sized_broadcast(by_text, size=F.size("places") * 16 + 32), "key", "left")
    none = F.array().cast(by_text.schema["places"].dataType)
    return joined.select(F.col("_id").alias(id), "n_words", F.coalesce("places", none).alias("places"))


def labels(places: Column, templates: tuple[Template, ...] = TEMPLATES) -> Column:
    names = F.array(*(F.lit(t.label) for t in templates))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: names[p["template"]]))), ",")


def base_places(places: Column, templates: tuple[Template, ...] = TEMPLATES) -> Column:
    """The places of the plain phrases, by start."""
    plain = [i for i, t in enumerate(templates) if t.base]
    return F.filter(places, lambda p: p["template"].isin(plain))
