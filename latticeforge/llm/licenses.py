"""Licence recognition by sentence rules.

Built-in DataFrame functions only. Comment leaders go and wrapped lines are joined; blank lines and the ends of sentences bound
what is left. The sentences are normalised, and the known licence sentences in them mapped to identifiers, wherever they
stand: a notice may lack its full stops. The sequence of identifiers is matched against licence rules, in their order: a
rule takes its identifiers out of the sequence, so a sentence counts for the first rule that fits. Sentences that speak of
licensing and hold nothing known are counted, which tells texts that need a look from those that are settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

# Sentences of well-known licences, normalised, as far as they are the same in all copies. Some words may vary.
_SOME = "(?:[a-z0-9.+/]+ ){1,12}"
_WORK = "(?:this (?:work|file|software|project|document|program|code|library) is )?"
_UNDER = _WORK + "(?:licensed|released|distributed|available) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
_LATER = "(?: or (?:at your option )?(?:any )?later(?: version)?)?"
_CC = "(?:licensed|released|distributed|available) under (?:an? |the )?(?:terms of the )?(?:creative commons )?(?:cc )?"
_GNU = "(?:this program|this library|this file|you can redistribute it and/or modify it|it) (?:and/or modify it )?under the terms of the gnu"
SENTENCES = [
    ("spdx-apache-2.0", "spdx license identifier apache 2\\.0"),
    ("spdx-mit", "spdx license identifier mit"),
    ("spdx-isc", "spdx license identifier isc"),
    ("spdx-zlib", "spdx license identifier zlib"),
    ("spdx-unlicense", "spdx license identifier unlicense"),
    ("spdx-bsd-3", "spdx license identifier bsd 3 clause"),
    ("spdx-bsd-2", "spdx license identifier bsd 2 clause"),
    ("spdx-agpl-3", "spdx license identifier agpl 3\\.0(?: only| or later)?"),
    ("spdx-lgpl", "spdx license identifier lgpl (?:2\\.1|3\\.0|2\\.0)(?: only| or later)?"),
    ("spdx-gpl-3", "spdx license identifier gpl 3\\.0(?: only| or later)?"),
    ("spdx-gpl-2", "spdx license identifier gpl 2\\.0(?: only| or later)?"),
    ("spdx-mpl-2", "spdx license identifier mpl 2\\.0"),
    ("spdx-epl-2", "spdx license identifier epl 2\\.0"),
    ("apache-2.0", _UNDER + "apache (?:software )?license(?: version| v)? ?2(?:\\.0)?(?: the license)?"),
    ("apache-use", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit", _UNDER + "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc-grant", "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-disclaim", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib-origin", "the origin of this software must not be misrepresented"),
    ("zlib-altered", "altered source versions must be plainly marked as such"),
    ("zlib-notice", "this notice may not be removed or altered from any source distribution"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("unlicense-use", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("as-is", "(?:the|this) software is provided (?:by " + _SOME + ")?as is"),
    ("no-liability", "in no event shall " + _SOME + "be (?:held )?liable for any|in no event will " + _SOME + "be held liable for any"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", "neither the name of " + _SOME + "nor the names of its contributors may be used to endorse"),
    ("bsd", _UNDER + "(?:new |simplified |revised )?bsd(?: [23] clause)? license"),
    ("lgpl", _UNDER + "gnu (?:lesser|library) general public license"),
    ("agpl", _UNDER + "gnu affero general public license"),
    ("gpl-3", _UNDER + "gnu general public license(?: gpl)?(?: version| v)? ?3(?:\\.0)?" + _LATER),
    ("gpl-2", _UNDER + "gnu general public license(?: gpl)?(?: version| v)? ?2(?:\\.0)?" + _LATER),
    ("gpl-free", "this (?:program|library|file|software) is free software"),
    ("lgpl-modify", _GNU + " (?:lesser|library) general public license as published by the free software foundation"),
    ("agpl-modify", _GNU + " affero general public license as published by the free software foundation"),
    ("gpl-modify-3", _GNU + " general public license as published by the free software foundation either version 3 of the license" + _LATER),
    ("gpl-modify-2", _GNU + " general public license as published by the free software foundation either version 2 of the license" + _LATER),
    ("gpl-hope", "this (?:program|library|file) is distributed in the hope that it will be useful"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v ?2\\.0"),
    ("epl-2", "(?:this program and the accompanying materials are made )?available under the terms of the eclipse public license v ?2\\.0"),
    ("epl-1", "(?:this program and the accompanying materials are made )?available under the terms of the eclipse public license v ?1\\.0"),
    ("cc-by-nc-sa", _CC + "(?:by nc sa|attribution noncommercial sharealike)"),
    ("cc-by-nc-nd", _CC + "(?:by nc nd|attribution noncommercial noderivatives)"),
    ("cc-by-nc", _CC + "(?:by nc|attribution noncommercial)"),
    ("cc-by-sa", _CC + "(?:by sa|attribution sharealike)"),
    ("cc-by-nd", _CC + "(?:by nd|attribution noderivatives)"),
    ("cc-by", _CC + "(?:by|attribution)"),
    ("cc0", "cc0|dedicated to the public domain|released into the public domain"),
    ("reserved", "all rights reserved"),
    ("copyright", "copyright (?:c )?(?:[a-z.]+ )?[12][0-9]{3}"),
]
# Licence rules: ordered identifiers that follow each other; earlier rules take sentences first.
RULES = [
    ("Apache-2.0", ["apache-2.0", "apache-use", "apache-copy", "apache-basis", "apache-see"]),
    ("Apache-2.0", ["apache-2.0", "apache-use"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is", "no-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "as-is", "no-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "as-is", "no-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    *((name, ["gpl-free", i, "gpl-hope"]) for name, i in (("LGPL", "lgpl-modify"), ("AGPL", "agpl-modify"))),
    *((name, ["gpl-free", i]) for name, i in (("LGPL", "lgpl-modify"), ("AGPL", "agpl-modify"))),
    ("ISC", ["isc-grant", "isc-disclaim", "no-liability"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-as-is", "no-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("Zlib", ["zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("Unlicense", ["unlicense-free", "unlicense-use"]),
    ("Unlicense", ["unlicense-free"]),
    ("EPL-2.0", ["epl-2"]),
    ("EPL-1.0", ["epl-1"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-modify-3", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-modify-3"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-modify-2", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-modify-2"]),
    *((name, [i]) for name, i in (("Apache-2.0", "spdx-apache-2.0"), ("MIT", "spdx-mit"), ("BSD-3-Clause", "spdx-bsd-3"), ("BSD-2-Clause", "spdx-bsd-2"), ("GPL-3.0", "spdx-gpl-3"), ("GPL-2.0", "spdx-gpl-2"), ("MPL-2.0", "spdx-mpl-2"), ("ISC", "spdx-isc"), ("Zlib", "spdx-zlib"), ("Unlicense", "spdx-unlicense"), ("AGPL", "spdx-agpl-3"), ("LGPL", "spdx-lgpl"), ("EPL-2.0", "spdx-epl-2"))),
    *((name, [i]) for name, i in (("Apache-2.0", "apache-2.0"), ("MIT", "mit"), ("BSD", "bsd"), ("LGPL", "lgpl"), ("AGPL", "agpl"), ("GPL-3.0", "gpl-3"), ("GPL-2.0", "gpl-2"), ("MPL-2.0", "mpl-2"))),
    *((name, [i]) for name, i in (("CC-BY-NC-SA", "cc-by-nc-sa"), ("CC-BY-NC-ND", "cc-by-nc-nd"), ("CC-BY-NC", "cc-by-nc"), ("CC-BY-SA", "cc-by-sa"), ("CC-BY-ND", "cc-by-nd"), ("CC-BY", "cc-by"), ("CC0-1.0", "cc0"))),
    ("All-Rights-Reserved", ["copyright", "reserved"]),
    ("All-Rights-Reserved", ["reserved"]),
]
HINT = r"licen[cs]e|copyright|warrant|permission is|permission to use|redistribut|rights reserved|public domain|provided as is|free software|liable|applicable law|in the hope|\bcc0\b|endorse|source code form|misrepresented|plainly marked|may not be removed or altered|anyone is free to"
#: A word of every hint: what has none of them is not looked at further.
QUICK = r"licen[cs]e|copyright|warrant|permission|redistribut|reserved|domain|provided|software|liable|applicable|hope|cc0|endorse|source|misrepresented|plainly|removed|anyone"
#: Any known sentence; at a place, the first that fits.
KNOWN = r"\b(?:" + "|".join(f"(?:{p})" for _, p in SENTENCES) + r")\b"
URL = r"https?://[^\x20\x09-\x0D]*"
LEADER = r"(^|\n)[\t ]*(?:<!--|[*#;%/]+|--+|dnl\b|rem\b)"


def _escaped(i: str) -> str:
    return i.replace(".", r"\.")


def _rule(ids: list[str]) -> str:
    return "," + ",".join(map(_escaped, ids)) + ","


def sentences(text: Column) -> Column:
    """Normalised sentences with a hint of licensing, in order; lines are joined unless a blank one is between."""
    text = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), LEADER, "$1")
    plain = F.regexp_replace(plain, URL, " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\bv\.[\t\n ]*([0-9])", "v$1"), r"\n[\t ]*\n", "\u0001")
    parts = F.split(F.regexp_replace(plain, r"[.!?;][\x20\x09-\x0D]+", "\u0001"), "\u0001")
    clean = F.transform(F.filter(parts, lambda s: s.rlike(QUICK)), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9.+/]+", " "), r"^[ ./+]+|[ ./+]+$", "")))
    return F.when(text.rlike(QUICK), F.filter(clean, lambda s: s.rlike(HINT))).otherwise(F.array().cast("array<string>"))


def _identifier(sentence: Column) -> Column:
    out = F.lit("?")
    for name, pattern in reversed(SENTENCES):
        out = F.when(sentence.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def recognise(docs: DataFrame, text_column: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the columns licenses (names joined by commas, in order of the rules), sentence_ids (identifiers in
    order of the text, "?" for a sentence with none) and n_unknown; each name begins with ``prefix``.

    Null and empty texts have none. Sentences of any length are searched whole. Rows are kept one by one, so repeated rows
    and no rows need no care; ``prefix`` keeps the names apart from columns that ``docs`` already has.
    """
    known = lambda s: F.regexp_extract_all(s, F.lit(f"({KNOWN})"), F.lit(0))
    named = lambda s: F.when(s.rlike(KNOWN), F.transform(known(s), _identifier)).otherwise(F.array(F.lit("?")))
    ids = F.flatten(F.transform(sentences(docs[text_column].cast("string")), named))
    work, found = f"{prefix}sentence_ids", f"{prefix}licenses"
    out = docs.withColumn(work, F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(",")))
    # Identifiers of a rule follow each other; commas are doubled, so that matches do not share one.
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_pattern(rule)).alias("pattern")) for name, rule in RULES])
    start = F.struct(F.col(work).alias("rest"), F.array().cast("array<string>").alias("names"))
    fits = lambda acc, r: F.regexp_like(acc["rest"], r["pattern"])
    step = lambda acc, r: F.struct(
        F.regexp_replace(acc["rest"], r["pattern"], F.lit(",,")).alias("rest"),
        F.when(fits(acc, r), F.array_append(acc["names"], r["name"])).otherwise(acc["names"]).alias("names"),
    )
    names = F.aggregate(rules, start, step, lambda acc: F.array_join(F.array_distinct(acc["names"]), ","))
    out = out.withColumn(found, F.when(F.length(work) > 2, names).otherwise(""))
    clean = F.regexp_replace(F.regexp_replace(F.col(work), r"^,|,$", ""), ",,", ",")
    unknown = F.size(F.split(F.col(work), r"\?")) - 1
    return out.select(*[out[c] for c in docs.columns], found, clean.alias(work), unknown.cast("long").alias(f"{prefix}n_unknown"))


def _pattern(rule: list[str]) -> str:
    return ",".join(_rule([i]) for i in rule).replace(",,,", ",,")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_full_match(s, {quote(p)}) THEN {quote(n)}" for n, p in SENTENCES)
    steps, last = [], "ids"
    for k, (name, rule) in enumerate(RULES):
        pattern = _pattern(rule)
        steps.append(f"r{k} AS (SELECT * EXCLUDE (rest, names), regexp_replace(rest, {quote(pattern)}, ',,', 'g') AS rest, CASE WHEN regexp_matches(rest, {quote(pattern)}) AND NOT list_contains(names, {quote(name)}) THEN list_append(names, {quote(name)}) ELSE names END AS names FROM {last})")
        last = f"r{k}"
    return f"""
WITH joined AS (
  SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '\\r\\n?', chr(10), 'g'), {quote(LEADER)}, '\\1', 'g') AS t FROM documents
), parts AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {quote(URL)}, ' ', 'g'), '\\bv\\.[\\t\\n ]*([0-9])', 'v\\1', 'g'), '\\n[\\t ]*\\n', chr(1), 'g'), '[.!?;][\\x20\\x09-\\x0D]+', chr(1), 'g'), chr(1)) AS p FROM joined
), clean AS (
  SELECT doc_id, [trim(regexp_replace(regexp_replace(s, '[^a-z0-9.+/]+', ' ', 'g'), '^[ ./+]+|[ ./+]+$', '', 'g')) FOR s IN p] AS p FROM parts
), hinted AS (
  SELECT doc_id, [s FOR s IN p IF regexp_matches(s, {quote(HINT)})] AS p FROM clean
), found AS (
  SELECT doc_id, flatten([CASE WHEN regexp_matches(s, {quote(KNOWN)}) THEN regexp_extract_all(s, {quote(KNOWN)}) ELSE ['?'] END FOR s IN p]) AS p FROM hinted
), named AS (
  SELECT doc_id, [CASE {cases} ELSE '?' END FOR s IN p] AS p FROM found
), ids AS (
  SELECT doc_id, ',' || array_to_string(p, ',,') || ',' AS work, ',' || array_to_string(p, ',,') || ',' AS rest, []::VARCHAR[] AS names FROM named
), {', '.join(steps)}
SELECT doc_id, array_to_string(names, ',') AS licenses, replace(regexp_replace(work, '^,|,$', '', 'g'), ',,', ',') AS sentence_ids,
  (length(work) - length(replace(work, '?', '')))::BIGINT AS n_unknown
FROM {last}
"""


ORACLE_SQL = _oracle()
