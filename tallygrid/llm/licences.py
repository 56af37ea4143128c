"""License scans: sentences become identifiers, and ordered rules read the sequence of identifiers.

A text is normalised to lower-case words between marks for line and sentence ends, without comment marks at the heads of
lines. A known sentence that begins and ends at such marks becomes its identifier, however many lines it is wrapped over;
other text is left out of the sequence. The licences of an SPDX expression are identifiers as they stand. Rules are sequences of identifiers, longer ones first; a rule that is
found takes its identifiers away, so parts of a licence do not count as another. Each row is judged by itself; nothing is
shuffled.

Defined results: null and empty texts have no sentences and no licence; repeated rows are judged one by one; no rows give
no rows; other columns of the input play no part. Texts have no length limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences by identifier.
SENTENCES = {
    "all_rights": ("all rights reserved",),
    "apache_copy": (
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "apache_grant": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "this software is licensed under the apache license version 2 0"),
    "apache_use": ("you may not use this file except in compliance with the license",),
    "asis": (
        "this software is provided as is without warranty of any kind",
        "the software is provided as is without warranty of any kind express or implied",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement"),
    "binary_form": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",),
    "cc_by": ("licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"),
    "cc_by_nc": (
        "licensed under cc by nc 4 0",
        "licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc_by_sa": (
        "licensed under cc by sa 4 0",
        "licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc_zero": ("this work is dedicated to the public domain", "released under cc0 1 0"),
    "agpl_terms": (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version",),
    "gpl_free": ("this program is free software", "this library is free software"),
    "gpl_terms": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation",),
    "gpl2_later": ("either version 2 of the license or at your option any later version",),
    "gpl3_terms": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version",),
    "lgpl21_later": ("either version 2 1 of the license or at your option any later version",),
    "lgpl3_terms": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version",),
    "lgpl_terms": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
        "the free software foundation",),
    "gpl2": ("this work is licensed under the gnu general public license version 2",),
    "gpl3": ("this work is licensed under the gnu general public license version 3",),
    "mit_grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions"),
    "mit_name": ("released under the mit license", "licensed under the mit license"),
    "mit_notice": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the software",
        "the above copyright notice and this permission notice including the next paragraph shall be included in all copies "
        "or substantial portions of the software"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "no_endorsement": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",),
    "source_form": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer",),
}
# A sentence that starts so is a notice, whatever years and names follow.
NOTICES = {
    "copyright": r"^(?:copyright|c) (?:c )?(?:[0-9]{4}|by )",
    "no_endorsement": r"^neither the names? of (?:[a-z0-9]+ ){1,20}nor the names of (?:its|their) contributors may be used to "
                      r"endorse or promote products ",
}
# The ordered rules, (licence, class, identifiers).
RULES = (
    ("BSD-3-Clause", "permissive", ("bsd_grant", "source_form", "binary_form", "no_endorsement")),
    ("Apache-2.0", "permissive", ("apache_grant", "apache_use", "apache_copy")),
    ("BSD-2-Clause", "permissive", ("bsd_grant", "source_form", "binary_form")),
    ("MIT", "permissive", ("mit_grant", "mit_notice", "asis")),
    ("MIT", "permissive", ("mit_grant", "mit_notice")),
    ("GPL-3.0", "copyleft", ("gpl_free", "gpl3_terms")),
    ("AGPL-3.0", "copyleft", ("gpl_free", "agpl_terms")),
    ("LGPL-3.0", "copyleft", ("gpl_free", "lgpl3_terms")),
    ("LGPL-2.1", "copyleft", ("gpl_free", "lgpl_terms", "lgpl21_later")),
    ("LGPL", "copyleft", ("gpl_free", "lgpl_terms")),
    ("GPL-2.0", "copyleft", ("gpl_free", "gpl_terms", "gpl2_later")),
    ("GPL", "copyleft", ("gpl_free", "gpl_terms")),
    ("GPL-3.0", "copyleft", ("gpl3",)),
    ("GPL-2.0", "copyleft", ("gpl2",)),
    ("MPL-2.0", "copyleft", ("mpl",)),
    ("Apache-2.0", "permissive", ("apache_grant",)),
    ("MIT", "permissive", ("mit_name",)),
    ("CC-BY-NC-4.0", "restricted", ("cc_by_nc",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc_by_sa",)),
    ("CC-BY-4.0", "permissive", ("cc_by",)),
    ("CC0-1.0", "permissive", ("cc_zero",)),
    ("proprietary", "restricted", ("copyright", "all_rights")),
    ("proprietary", "restricted", ("all_rights",)),
)
CLASSES = ("restricted", "copyleft", "permissive")
# An SPDX expression: names of licences joined by words in capitals, in brackets or not.
SPDX_NAME = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.:-]*[A-Za-z0-9])?\+?\)*"
SPDX = (rf"(?i:SPDX-License-Identifier:)[\x20\x09]*({SPDX_NAME}"
        rf"(?:[\x20\x09]+(?:AND|OR|WITH)[\x20\x09]+{SPDX_NAME})*)")
# Names that begin so are of the class; any other name is taken for restricted.
SPDX_CLASSES = {
    "restricted": r"(?i)^CC-BY-N[CD]|-NC-",
    "copyleft": r"(?i)^(?:[AL]?GPL|GFDL|MPL|EPL|CPL|CDDL|EUPL|OSL|MS-RL|CC-BY-SA|CECILL-[12]|OFL|ODbL|Sleepycat)",
    "permissive": r"(?i)^(?:MIT|X11|ISC|0?BSD|Apache|AFL|Artistic-2|BSL-1|CC-BY-[0-9]|CC0|MS-PL|NCSA|PSF|Python|PostgreSQL|"
                  r"Unlicense|UPL|W3C|WTFPL|Zlib|libpng|curl|Unicode|HPND|FTL|IJG)",
}
# Every known sentence, notice and expression matches this, so a text that does not need not be normalised.
GATE = "(?i)licen[sc]|copyright|software|rights reserved|public domain|distribution|cc0|\\(c\\) [0-9]{4}"
COMMENT = r"(?m)^[\x20\x09]*(?:(?://+|/?\*+|#+|;+|--+|%+|>+|<!--|\(?[0-9]{1,2}\))[\x20\x09]*)+"
SENTENCE_END, LINE_END = r"(?<=[.!?;:])[\x20\x09-\x0D]+", r"[\x0A-\x0D]+"
# Marks of both stand alone between blanks.
MARK = r"\x01"


def _known() -> str:
    """One pattern of all sentences and notices, longer sentences first, whose words may lie on several lines."""
    between = rf"(?:\x20{MARK})*+\x20"
    texts = sorted((t for texts in SENTENCES.values() for t in texts), key=len, reverse=True)
    notices = [pattern.lstrip("^").replace(" ", between) for pattern in NOTICES.values()]
    whole = "|".join(text.replace(" ", between) for text in texts)
    return rf"(?<={MARK}\x20)(?:(?:{whole})(?=\x20{MARK})|{'|'.join(notices)})"


def normalised(text: Column) -> Column:
    """Words of letters and digits in lower case and marks where lines and sentences end, one blank between."""
    bare = F.regexp_replace(text, COMMENT, "")
    marked = F.regexp_replace(F.regexp_replace(bare, SENTENCE_END, " \x01 "), LINE_END, " \x01 ")
    words = F.regexp_replace(F.lower(marked), rf"[^a-z0-9{MARK}]+", " ")
    return F.concat(F.lit("\x01 "), F.trim(words), F.lit(" \x01"))


def identifier(sentence: Column) -> Column:
    """The identifier of a sentence or notice, or null."""
    known = F.create_map(*[
        F.lit(part) for name, texts in SENTENCES.items() for text in texts for part in (text, name)])
    notice = F.lit(None).cast("string")
    for name, pattern in NOTICES.items():
        notice = F.when(sentence.rlike(pattern), F.lit(name)).otherwise(notice)
    return F.coalesce(F.try_element_at(known, sentence), notice)


def _sentences(text: Column) -> Column:
    """The identifiers of the known sentences in order."""
    found = F.regexp_extract_all(normalised(text), F.lit(_known()), F.lit(0))
    return F.transform(found, lambda s: identifier(F.regexp_replace(s, rf"\x20{MARK}", "")))


def _spdx(expression: Column) -> Column:
    """``spdx:<name>`` of each licence of an expression; exceptions are none."""
    names = F.regexp_extract_all(
        F.regexp_replace(expression, r"[\x20\x09]WITH[\x20\x09]+[^\x20\x09]+", ""), F.lit(r"[^\x20\x09()]+"), F.lit(0))
    return F.transform(
        F.filter(names, lambda name: ~name.isin("AND", "OR")), lambda name: F.concat(F.lit("spdx:"), name))


def _classed(identifier_: Column) -> Column:
    """The licence and class of an SPDX identifier."""
    name, kind = F.substr(identifier_, F.lit(len("spdx:") + 1)), F.lit("restricted")
    for class_, pattern in reversed(SPDX_CLASSES.items()):
        kind = F.when(name.rlike(pattern), F.lit(class_)).otherwise(kind)
    return F.concat_ws(" ", name, kind)


def recognise(docs: DataFrame) -> DataFrame:
    """``(row, identifiers, licences, classes)``: ``row`` holds the columns of the input; the identifiers of the known
    sentences in order, the licences in the order of the rules, then those of SPDX expressions, each once, and their classes."""
    text = F.coalesce("text", F.lit(""))
    step = docs.select(F.struct("*").alias("row"), text.alias("text"))
    none = F.array().cast("array<string>")
    said = F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))
    around = F.flatten(F.transform(F.split("text", SPDX, -1), lambda part, i: F.concat(
        _sentences(part), F.coalesce(_spdx(F.get(said, i)), none))))
    known = F.when(F.col("text").rlike(SPDX), around).otherwise(_sentences(F.col("text")))
    step = step.select("row", F.when(F.col("text").rlike(GATE), known).otherwise(
        F.array().cast("array<string>")).alias("identifiers"))
    # The sequence as text, one blank around each identifier and two between them.
    rest = F.array_join(F.transform("identifiers", lambda name: F.concat(F.lit(" "), name, F.lit(" "))), "")
    step = step.withColumn("_rest", rest).withColumn("_found", F.array().cast("array<string>"))
    for licence, kind, parts in RULES:
        wanted = "".join(f" {part} " for part in parts)
        has = F.col("_rest").contains(wanted)
        step = step.withColumns({
            "_found": F.when(has, F.array_append("_found", F.lit(f"{licence} {kind}"))).otherwise(F.col("_found")),
            "_rest": F.when(has, F.replace("_rest", F.lit(wanted), F.lit(" | "))).otherwise(F.col("_rest"))})
    by_name = F.transform(F.filter("identifiers", lambda name: name.startswith("spdx:")), _classed)
    both = F.transform(F.array_distinct(F.concat("_found", by_name)), lambda pair: F.split(pair, " "))
    return step.select(
        "row", "identifiers", F.transform(both, lambda p: F.get(p, F.lit(0))).alias("licences"),
        F.transform(both, lambda p: F.get(p, F.lit(1))).alias("classes"))


def digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_sentences, identifiers, licences, class)``: the class is the strictest, or ``none``."""
    strictest = F.coalesce(*[F.when(F.array_contains("classes", c), F.lit(c)) for c in CLASSES], F.lit("none"))
    return recognise(docs.select("doc_id", "text")).select(
        "row.doc_id", F.size("identifiers").cast("long").alias("n_sentences"),
        F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licences", ",").alias("licences"),
        strictest.alias("class"))
