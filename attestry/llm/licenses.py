"""Licence scan by sentence rules, in DataFrame functions only.

A text is normalised (lower case, runs of anything but letters and digits, comment
marks among them, as one space) with its cuts marked: full ones at `.!?` before
white space and at blank lines, and half ones at line ends, at `;` and `:` before white
space and at `.` before white space and a digit. A known licence sentence is found between any two cuts and may run over
half cuts, but not over full ones, so that wrapped texts are read; longer sentences
go first. Their identifiers, in order, are then matched against ordered rules: a
rule names a licence and the sequence of identifiers that declares it, in order
and with no other known sentence, but any unknown ones, between. Licences of tags whose
identifiers are joined by OR, AND or WITH, or stand in brackets, are added.

Defined results: null and empty texts recognise nothing (0, two empty strings,
false); texts of any length are scanned whole in one projection without a
shuffle; a licence is named once however often it is declared; licences are in
order of their rules, then those of tags alone as they stand; exceptions after WITH and
unknown identifiers name none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import read_table

# Normalised sentences of public licence texts, by identifier.
SENTENCES = {
    "released under the mit license": "mit.short",
    "licensed under the mit license": "mit.short",
    "this project is licensed under the mit license": "mit.short",
    "spdx license identifier mit": "mit.tag",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.notice",
    "licensed under the apache license version 2 0": "apache.short",
    "licensed under the apache license version 2 0 the license": "apache.head",
    "you may not use this file except in compliance with the license": "apache.may",
    "you may obtain a copy of the license at": "apache.copy",
    "spdx license identifier apache 2 0": "apache.tag",
    "this work is licensed under the gnu general public license version 3": "gpl3.short",
    "spdx license identifier gpl 3 0 only": "gpl3.tag",
    "spdx license identifier gpl 3 0 or later": "gpl3.tag",
    "spdx license identifier gpl 2 0 only": "gpl2.tag",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3.head",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2.head",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl.warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd.grant",
    "spdx license identifier bsd 3 clause": "bsd3.tag",
    "spdx license identifier bsd 2 clause": "bsd2.tag",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.names",
    "licensed under cc by nc 4 0": "ccbync.short",
    "licensed under cc by 4 0": "ccby.short",
    "licensed under cc by sa 4 0": "ccbysa.short",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby.long",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl.head",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl.copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21.head",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3.head",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3.head",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3.head",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "cc0.deed",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0.waiver",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0.software",
    "this is free and unencumbered software released into the public domain": "unlicense.head",
    "all rights reserved": "reserved.line",
}
# Licence by sequence of sentence identifiers, in order of precedence.
RULES = [
    ("MIT", ("mit.grant", "mit.notice")),
    ("MIT", ("mit.grant",)),
    ("MIT", ("mit.short",)),
    ("MIT", ("mit.tag",)),
    ("Apache-2.0", ("apache.head", "apache.may", "apache.copy")),
    ("Apache-2.0", ("apache.short",)),
    ("Apache-2.0", ("apache.tag",)),
    ("GPL-3.0", ("gpl3.head", "gpl.warranty")),
    ("GPL-3.0", ("gpl3.head",)),
    ("GPL-3.0", ("gpl3.short",)),
    ("GPL-3.0", ("gpl3.tag",)),
    ("GPL-2.0", ("gpl2.head",)),
    ("GPL-2.0", ("gpl2.tag",)),
    ("BSD-3-Clause", ("bsd.grant", "bsd.names")),
    ("BSD-3-Clause", ("bsd3.tag",)),
    ("BSD-2-Clause", ("bsd.grant",)),
    ("BSD-2-Clause", ("bsd2.tag",)),
    ("CC-BY-NC-4.0", ("ccbync.short",)),
    ("CC-BY-SA-4.0", ("ccbysa.short",)),
    ("CC-BY-4.0", ("ccby.short",)),
    ("CC-BY-4.0", ("ccby.long",)),
    ("MPL-2.0", ("mpl.head",)),
    ("Unlicense", ("unlicense.head",)),
    ("ISC", ("isc.grant",)),
    ("LGPL-2.1", ("lgpl21.head",)),
    ("LGPL-3.0", ("lgpl3.head",)),
    ("AGPL-3.0", ("agpl3.head",)),
    ("CC0-1.0", ("cc0.deed",)),
    ("CC0-1.0", ("cc0.waiver",)),
    ("CC0-1.0", ("cc0.software",)),
    ("all-rights-reserved", ("reserved.line",)),
]
# Identifiers of the SPDX list in lower case, without "-only", "-or-later" and "+", and the licence's name here.
TAGS = {
    "mit": "MIT", "apache-2.0": "Apache-2.0", "gpl-3.0": "GPL-3.0", "gpl-2.0": "GPL-2.0", "lgpl-2.1": "LGPL-2.1", "lgpl-3.0": "LGPL-3.0", "agpl-3.0": "AGPL-3.0",
    "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause", "isc": "ISC", "mpl-2.0": "MPL-2.0", "cc0-1.0": "CC0-1.0", "cc-by-4.0": "CC-BY-4.0",
    "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc-by-nc-4.0": "CC-BY-NC-4.0", "unlicense": "Unlicense",
}
#: A tag with its identifiers: the first, and others joined to it.
TAG = r"(?i)spdx-license-identifier:[ \t]*((?:[( \t]*[a-z0-9][a-z0-9.+-]*[) \t]*)(?:\b(?:or|and|with)[ \t(]+[a-z0-9][a-z0-9.+-]*[) \t]*)*)"
#: Between identifiers; what WITH names is an exception and no licence.
JOINT = r"[ \t()]*with[ \t]+[a-z0-9.+-]+[ \t()]*|[ \t()]+(?:or|and)[ \t()]+|[ \t()]+"
#: Every known sentence holds one of these; other texts need not be cut.
ANCHOR = r"(?i)licen[cs]|rights[^a-z0-9]+reserved|permission|free\s+software|redistribution|copyright|unencumbered"


def _marked(text: Column) -> Column:
    """The normalised words between cuts, `H` full and `S` half, each known sentence replaced by `K` and its number."""
    t = F.regexp_replace(F.lower(text), r"[.!?](?=[ \t\r\n])(?!(?<=\.)[ \t]+[0-9])|\n(?:[^a-z0-9\n]*\n)+", "H")
    t = F.concat(F.lit("H"), F.regexp_replace(t, r"[;:](?=[ \t\r])|\.(?=[ \t]+[0-9])|\n", "S"), F.lit("H"))
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9HS]+", " "), "[ S]*H[ HS]*", " H ")
    t = F.regexp_replace(t, " ?S[ S]*", " S ")
    for sentence, i in sorted(zip(SENTENCES, range(len(SENTENCES)), strict=True), key=lambda x: (-len(x[0]), x[1])):
        t = F.regexp_replace(t, f"(?<=[HS] ){sentence.replace(' ', ' (?:S )?')}(?= [HS])", f"K{i}")
    return t


def _tagged(text: Column) -> Column:
    """Licences of all tags of a text, as they stand."""
    names = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TAG)), lambda t: F.split(F.trim(F.lower(t)), JOINT)))
    plain = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, r"\.$", ""), r"(?:-only|-or-later|\+)$", ""))
    return F.array_compact(F.transform(plain, lambda x: F.try_element_at(names, x)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_recognised, sentence_ids, licenses, has_license."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = F.array(*[F.lit(i) for i in SENTENCES.values()])
    found = F.transform(F.regexp_extract_all(_marked(text), F.lit("K([0-9]+)")), lambda k: F.element_at(ids, k.cast("int") + 1))
    marks = F.when(F.regexp_like(text, F.lit(ANCHOR)), found).otherwise(F.array().cast("array<string>"))
    tags = F.when(F.regexp_like(text, F.lit("(?i)spdx-license-identifier:")), _tagged(text)).otherwise(F.array().cast("array<string>"))
    out = docs.select(F.col(id_col), marks.alias("marks"), tags.alias("names of tags"))
    line = F.concat(F.lit(" "), F.array_join("marks", " "), F.lit(" "))
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(line, F.lit(f" {' '.join(ids)} ")), F.lit(name)) for name, ids in RULES])))
    # a bare grant is the two-clause form only where the names clause does not follow
    hits = F.array_distinct(F.concat(hits, F.col("names of tags")))
    found = F.when(F.array_contains(hits, "BSD-3-Clause"), F.array_remove(hits, "BSD-2-Clause")).otherwise(hits)
    return out.select(id_col, F.size("marks").cast("long").alias("n_recognised"), F.array_join("marks", " ").alias("sentence_ids"), F.array_join(found, ",").alias("licenses"), (F.size(found) > 0).alias("has_license"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences declared in each of `documents`."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """DuckDB SQL for op4's rows where no known sentence is wrapped or runs over a `;`, `:` or a `.` and a digit, and no rule's sentences have others between."""
    quoted = lambda s: "'" + s + "'"
    known = "MAP {" + ", ".join(f"{quoted(s)}: {quoted(i)}" for s, i in SENTENCES.items()) + "}"
    tags = "MAP {" + ", ".join(f"{quoted(s)}: {quoted(n)}" for s, n in TAGS.items()) + "}"
    hits = ", ".join(f"CASE WHEN contains(line, ' {' '.join(ids)} ') THEN {quoted(name)} END" for name, ids in RULES)
    return rf"""
    WITH cut AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '{TAG}', 1), lambda t: regexp_split_to_array(trim(lower(t)), '{JOINT}'))),
      lambda x: {tags}[regexp_replace(regexp_replace(x, '\.$', ''), '(?:-only|-or-later|\+)$', '')]), lambda x: x IS NOT NULL) AS tagged, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, '[A-Za-z0-9]')) AS sentences FROM documents),
    marked AS (SELECT doc_id, tagged, list_transform(sentences, lambda s: coalesce({known}[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))], '_')) AS marks FROM cut),
    lined AS (SELECT doc_id, tagged, list_filter(marks, lambda m: m <> '_') AS recognised, ' ' || array_to_string(marks, ' ') || ' ' AS line FROM marked),
    hit AS (SELECT doc_id, tagged, recognised, list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM lined),
    all_hits AS (SELECT doc_id, recognised, list_concat(hits, tagged) AS hits FROM hit),
    named AS (SELECT doc_id, recognised, list_filter(hits, lambda x, i: list_position(hits, x) = i AND NOT (x = 'BSD-2-Clause' AND list_contains(hits, 'BSD-3-Clause'))) AS found FROM all_hits)
    SELECT doc_id, len(recognised) AS n_recognised, coalesce(array_to_string(recognised, ' '), '') AS sentence_ids, coalesce(array_to_string(found, ','), '') AS licenses, len(found) > 0 AS has_license FROM named
    """
