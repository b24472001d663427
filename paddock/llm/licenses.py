"""Licence scans by sentence rules: sentences to identifiers, identifier sequences to licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

# Well-known licence sentences, normalised (lower case, letters and digits, single spaces).
SENTENCES = {
    "apache2-ref": "licensed under the apache license version 2 0",
    "apache2-file": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit-ref": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-source": "redistributions of source code must retain the above copyright notice",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    "cc-by-ref": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl2-ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "all-rights": "all rights reserved",
}
# Ordered rules: the licence, and identifiers that follow each other among the recognised sentences.
RULES = (
    ("Apache-2.0", ("apache2-ref", "apache2-file")),
    ("Apache-2.0", ("apache2-ref",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-ref",)),
    ("GPL-3.0", ("gpl-free", "gpl-hope")),
    ("GPL-3.0", ("gpl3-ref",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("Proprietary", ("all-rights",)),
)

# Recognition over whole texts, where line breaks and comment marks are spaces. SPDX identifiers and patterns over normalised words.
# A name counts where a few words before it state a licence.
STATED = r"\b(?:under|terms of|subject to|spdx license identifier|licen[sc]e|licen[sc]ed)(?: [a-z0-9]+){0,8}? "
GNU = r"(?: as published by the free software foundation)?(?: either)?,? ?(?:version |v)?"
NAMES = (
    ("Apache-2.0", r"apache(?: software)?(?: public)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?\b"),
    ("MIT", r"mit(?: x11)?(?: licen[sc]e)?(?= |$)"),
    ("GPL-3.0", rf"(?:gnu general public licen[sc]e|gnu gpl|gpl){GNU} ?3\b"),
    ("GPL-2.0", rf"(?:gnu general public licen[sc]e|gnu gpl|gpl){GNU} ?2\b"),
    ("LGPL-3.0", rf"(?:gnu (?:lesser|library) general public licen[sc]e|gnu lgpl|lgpl){GNU} ?3\b"),
    ("LGPL-2.1", rf"(?:gnu (?:lesser|library) general public licen[sc]e|gnu lgpl|lgpl){GNU} ?2 1\b"),
    ("LGPL-2.0", rf"(?:gnu (?:lesser|library) general public licen[sc]e|gnu lgpl|lgpl){GNU} ?2\b(?! 1\b)"),
    ("AGPL-3.0", rf"(?:gnu affero general public licen[sc]e|gnu agpl|agpl){GNU} ?3\b"),
    ("BSD-3-Clause", r"(?:bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)\b"),
    ("BSD-2-Clause", r"(?:bsd 2 clause|(?:2|two) clause bsd|(?:simplified|freebsd) (?:bsd|licen[sc]e))\b"),
    ("ISC", r"isc(?: licen[sc]e)?(?= |$)"),
    ("MPL-2.0", r"(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?2(?: 0)?\b"),
    ("MPL-1.1", r"(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?1 1\b"),
    ("EPL-2.0", r"(?:eclipse public licen[sc]e|epl)(?: version| v)? ?2(?: 0)?\b"),
    ("EPL-1.0", r"(?:eclipse public licen[sc]e|epl)(?: version| v)? ?1(?: 0)?\b"),
    ("BSL-1.0", r"(?:boost software licen[sc]e|bsl)(?: version| v)? ?1(?: 0)?\b"),
    ("CC0-1.0", r"(?:cc0|creative commons zero)\b"),
    ("Zlib", r"zlib(?: libpng)?(?: licen[sc]e)?(?= |$)"),
    ("Unlicense", r"unlicense\b"),
)
# Sentences of the licence texts themselves: all of them, and none of the last.
BSD = ("redistribution and use in source and binary forms with or without modification are permitted", "source code must retain the", "binary form must reproduce the")
BSD_NAME = r"(?:neither the names? of|the names? of (?:[a-z0-9]+ ){0,8}?may not be used to endorse)"
ISC_GRANT = r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"
TEXTS = (
    ("MIT", ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",), None),
    ("BSD-3-Clause", (*BSD, BSD_NAME), None),
    ("BSD-2-Clause", BSD, BSD_NAME),
    ("ISC", (f"{ISC_GRANT} provided that",), None),
    ("0BSD", (ISC_GRANT,), f"{ISC_GRANT} provided that"),
    ("Unlicense", ("this is free and unencumbered software released into the public domain",), None),
    ("Zlib", ("provided as is without any express or implied warranty in no event will the authors be held liable",), None),
)
# Words without which no pattern matches.
HINTS = ("under", "terms of", "subject to", "licens", "licenc", "permission", "redistribution", "unencumbered", "held liable")
LONG_CC = (("creative commons attribution", "cc by"), ("non ?commercial", "nc"), ("share ?alike", "sa"), ("no ?deriv(?:ative)?s?(?: works)?", "nd"))
CC = r"cc (by(?: nc)?(?: sa| nd)?)(?: licen[sc]e)?(?: version| v)?(?: ?([1-4]) ([05])\b)?"


def text_licenses(text: Column) -> Column:
    """Comma-separated identifiers of the licences stated or quoted anywhere in a text, wrapped or not; Proprietary only where there is no other."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z0-9]+", " "))
    hinted = F.lit(False)
    for hint in HINTS:
        hinted |= F.contains(plain, F.lit(hint))
    short = plain
    for long, cc in LONG_CC:
        short = F.regexp_replace(short, long, cc)
    stated = F.regexp_extract_all(short, F.lit(f"{STATED}({CC})"), F.lit(1))
    part = lambda x, k: F.regexp_extract(x, CC, k)
    ccs = F.transform(stated, lambda x: F.concat(F.lit("CC-"), F.translate(F.upper(part(x, 1)), " ", "-"), F.when(part(x, 2) == "", "").otherwise(F.concat(F.lit("-"), part(x, 2), F.lit("."), part(x, 3)))))
    named = [F.when(F.regexp_like(plain, F.lit(STATED + pattern)), F.lit(name)) for name, pattern in NAMES]
    quoted = []
    for name, every, no in TEXTS:
        hit = ~F.regexp_like(plain, F.lit(no)) if no else F.lit(True)
        for pattern in every:
            hit &= F.regexp_like(plain, F.lit(pattern))
        quoted.append(F.when(hit, F.lit(name)))
    found = F.when(hinted, F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*named, *quoted)), ccs)))).otherwise(F.array().cast("array<string>"))
    reserved = F.when(F.contains(plain, F.lit("all rights reserved")), "Proprietary").otherwise("")
    return F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise(reserved)


def sentences(text: Column) -> Column:
    """Normalised sentences: they end at line breaks and at . ! ? before white space or the end."""
    ended = F.regexp_replace(text, r"[.!?]+([ \t\r\n]+|$)", "\n")
    plain = F.regexp_replace(F.translate(ended, UPPER, LOWER), r"[^a-z0-9\n]+", " ")
    return F.filter(F.transform(F.split(plain, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def license_scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """doc_id, n_sentences, n_known, sequence, licenses, text_licenses for every row of `docs`.

    `sequence` has the identifiers of recognised sentences in their order, `licenses` the licences of
    the rules found in it, each once, in the order of the rules; both take whole sentences on a line, as
    the SQL does. `text_licenses` has the licences recognised over the whole text, across line breaks and
    within sentences. Tables are constants of the plan, so
    nothing is shuffled. NULL and empty texts have no sentences; repeated rows are judged each; an empty
    table gives an empty result. Other columns are ignored.
    """
    by_text = F.create_map(*[F.lit(x) for name, s in known.items() for x in (s, name)])
    found = docs.select("doc_id", sentences(F.coalesce("text", F.lit(""))).alias("s"), text_licenses(F.col("text")).alias("text_licenses"))
    found = found.select("doc_id", "text_licenses", F.size("s").cast("long").alias("n_sentences"), F.filter(F.transform("s", lambda s: F.try_element_at(by_text, s)), lambda x: x.isNotNull()).alias("ids"))
    line = F.concat(F.lit(";"), F.array_join("ids", ";"), F.lit(";"))
    hits = F.array(*[F.when(F.contains(line, F.lit(f";{';'.join(ids)};")), F.lit(name)) for name, ids in rules])
    return found.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ";").alias("sequence"), F.array_join(F.array_distinct(F.array_compact(hits)), ",").alias("licenses"), "text_licenses")


# Further sentences and their beginnings, normalised; of several that begin alike the longest counts.
GPL_MODIFY = "you can redistribute it and or modify it under the terms of the gnu {}general public license"
BEGINNINGS = {s: name for name, s in SENTENCES.items() if name not in ("bsd-name", "gpl-free", "gpl3-ref", "cc-by-ref")} | {
    "apache license version 2 0": "apache2-title", "licensed under the apache license 2 0": "apache2-ref", "spdx license identifier apache 2 0": "apache2-ref",
    "licensed under the mit license": "mit-ref", "this project is licensed under the mit license": "mit-ref", "spdx license identifier mit": "mit-ref",
    "neither the name of": "bsd-name", "the name of the author may not be used to endorse": "bsd-name", "spdx license identifier bsd 3 clause": "bsd3-ref", "spdx license identifier bsd 2 clause": "bsd2-ref",
    "this program is free software " + GPL_MODIFY.format(""): "gpl-modify", GPL_MODIFY.format(""): "gpl-modify", GPL_MODIFY.format("lesser "): "lgpl-modify", "this library is free software " + GPL_MODIFY.format("lesser "): "lgpl-modify",
    "this program is free software " + GPL_MODIFY.format("") + " as published by the free software foundation either version 3 of the license": "gpl3-ref",
    "this program is free software " + GPL_MODIFY.format("") + " as published by the free software foundation either version 2 of the license": "gpl2-ref",
    "either version 2 of the license": "or-version-2", "either version 2 1 of the license": "or-version-2.1", "either version 3 of the license": "or-version-3", "version 2": "or-version-2", "version 3": "or-version-3",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref", "this work is licensed under the gnu general public license version 2": "gpl2-ref", "licensed under the gnu general public license version 3": "gpl3-ref",
    "spdx license identifier gpl 3 0": "gpl3-ref", "spdx license identifier gpl 2 0": "gpl2-ref", "licensed under cc by nc 4 0": "cc-by-nc-ref", "licensed under cc by 4 0": "cc-by-ref", "licensed under cc by sa 4 0": "cc-by-sa-ref",
    "this work is licensed under a creative commons attribution 4 0": "cc-by-ref", "this work is licensed under a creative commons attribution noncommercial 4 0": "cc-by-nc-ref", "this work is licensed under a creative commons attribution sharealike 4 0": "cc-by-sa-ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant", "this is free and unencumbered software released into the public domain": "unlicense",
}
# Ordered rules: the first that finds its identifiers one after another takes them, and later rules don't see them.
TAKING = (
    ("Apache-2.0", ("apache2-ref", "apache2-file", "apache2-copy")), ("Apache-2.0", ("apache2-ref", "apache2-file")), ("Apache-2.0", ("apache2-ref",)), ("Apache-2.0", ("apache2-title",)), ("MIT", ("mit-grant", "mit-notice", "as-is")), ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)), ("MIT", ("mit-ref",)), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")), ("BSD-3-Clause", ("bsd3-ref",)), ("BSD-2-Clause", ("bsd2-ref",)),
    ("LGPL-2.1", ("lgpl-modify", "or-version-2.1")), ("LGPL-3.0", ("lgpl-modify", "or-version-3")), ("GPL-2.0", ("gpl-modify", "or-version-2")), ("GPL-3.0", ("gpl-modify", "or-version-3")), ("GPL-3.0", ("gpl3-ref",)), ("GPL-2.0", ("gpl2-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)), ("CC-BY-SA-4.0", ("cc-by-sa-ref",)), ("CC-BY-4.0", ("cc-by-ref",)), ("MPL-2.0", ("mpl2-ref",)), ("ISC", ("isc-grant",)), ("Unlicense", ("unlicense",)),
)
RESERVED = "all-rights"
DENIED = ("not", "never", "nor", "isn", "without")
LENGTHS = sorted({len(s.split()) for s in BEGINNINGS}, reverse=True)


def license_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_parts, sequence, licenses of every row of `docs`, by sentences that may be wrapped and go on.

    A text is cut at line breaks and at . ! ? ; before white space. At every cut the words that follow, over later cuts
    too, are looked up among BEGINNINGS, the longest first; a part after one that ends in a denial begins nothing.
    `sequence` has the identifiers found, in order. The rules of TAKING are tried in order on it; the first that finds
    its identifiers takes them away. `licenses` has the licences found, each once, in the order of the rules;
    "Proprietary" where there are none but all rights are reserved. NULL and empty texts have no parts, repeated rows
    are judged each, an empty table gives an empty result, other columns are ignored; a text is taken whole. No shuffle.
    """
    ended = F.regexp_replace(F.coalesce("text", F.lit("")), r"[.!?;]+([ \t\r\n]+|$)", "\n")
    plain = F.regexp_replace(F.translate(ended, UPPER, LOWER), r"[^a-z0-9\n]+", " ")
    parts = docs.select("doc_id", F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("s"))
    known = F.create_map(*[F.lit(x) for pair in BEGINNINGS.items() for x in pair])
    looked = lambda w: F.coalesce(*[F.try_element_at(known, F.array_join(F.slice(w, 1, n), " ")) for n in LENGTHS])

    def named(part, i):
        ahead = F.split(F.array_join(F.slice(F.col("s"), i + 1, F.lit(LENGTHS[0])), " "), " ")
        before = F.when(i > 0, F.substring_index(F.element_at("s", F.greatest(i, F.lit(1))), " ", -1))
        return F.when(~F.coalesce(before.isin(*DENIED), F.lit(False)), F.element_at(F.transform(F.array(ahead), looked), 1))

    found = parts.select("doc_id", F.size("s").cast("long").alias("n_parts"), F.filter(F.transform("s", named), lambda x: x.isNotNull()).alias("ids"))
    found = found.withColumn("line", F.concat(F.lit(";"), F.array_join("ids", ";"), F.lit(";")))
    left, hits = F.col("line"), []
    for name, ids in TAKING:
        sought = F.lit(f";{';'.join(ids)};")
        hits.append(F.when(F.contains(left, sought), F.lit(name)))
        left = F.replace(left, sought, F.lit(";#;"))
    licences = F.array_join(F.array_distinct(F.array_compact(F.array(*hits))), ",")
    return found.select("doc_id", "n_parts", F.array_join("ids", ";").alias("sequence"), F.when(licences != "", licences).when(F.contains("line", F.lit(f";{RESERVED};")), "Proprietary").otherwise("").alias("licenses"))


def rules_sql(docs: str = "documents") -> str:
    """`license_rules` in DuckDB."""
    table = ", ".join(f"('{s}', '{name}')" for s, name in BEGINNINGS.items())
    looked = ", ".join(f"by_text[array_to_string(w[1:{n}], ' ')]" for n in LENGTHS)
    left, hits = "line", []
    for name, ids in TAKING:
        hits.append(f"case when contains({left}, ';{';'.join(ids)};') then '{name}' end")
        left = f"replace({left}, ';{';'.join(ids)};', ';#;')"
    order = ", ".join(dict.fromkeys(f"'{name}'" for name, _ in TAKING))
    denied = ", ".join(f"'{x}'" for x in DENIED)
    return f"""
with known(s, id) as (values {table}),
m as (select map_from_entries(list({{'key': s, 'value': id}})) as by_text from known),
t as (select doc_id, list_filter(list_transform(string_split(
        regexp_replace(translate(regexp_replace(coalesce(text, ''), '[.!?;]+([ \\t\\r\\n]+|$)', chr(10), 'g'), '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g'),
        chr(10)), lambda x: trim(x)), lambda x: x <> '') as s from {docs}),
p as (select row_number() over () as row, doc_id, s from t),
e as (select row, i, s[i - 1] as before, string_split(array_to_string(s[i:i + {LENGTHS[0] - 1}], ' '), ' ') as w from p, unnest(generate_series(1, len(s))) g(i)),
f as (select row, i, coalesce({looked}) as id from e, m where before is null or string_split(before, ' ')[-1] not in ({denied})),
g as (select row, list(id order by i) as ids from f where id is not null group by row),
l as (select doc_id, len(s)::bigint as n_parts, coalesce(array_to_string(ids, ';'), '') as sequence, ';' || coalesce(array_to_string(ids, ';'), '') || ';' as line from p left join g using (row)),
h as (select *, list_distinct(list_filter([{", ".join(hits)}], lambda x: x is not null)) as found from l)
select doc_id, n_parts, sequence, case when len(found) > 0 then array_to_string(list_filter([{order}], lambda x: list_contains(found, x)), ',') when contains(line, ';{RESERVED};') then 'Proprietary' else '' end as licenses from h
"""


def sql(docs: str = "documents") -> str:
    """The same in DuckDB."""
    table = ", ".join(f"('{s}', '{name}')" for name, s in SENTENCES.items())
    hits = ", ".join(f"case when contains(line, ';{';'.join(ids)};') then '{name}' end" for name, ids in RULES)
    order = ", ".join(dict.fromkeys(f"'{name}'" for name, _ in RULES))
    return f"""
with known(s, id) as (values {table}),
m as (select map_from_entries(list({{'key': s, 'value': id}})) as by_text from known),
t as (select doc_id, list_filter(list_transform(string_split(
        regexp_replace(translate(regexp_replace(coalesce(text, ''), '[.!?]+([ \\t\\r\\n]+|$)', chr(10), 'g'), '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g'),
        chr(10)), lambda x: trim(x)), lambda x: x <> '') as s from {docs}),
i as (select doc_id, len(s)::bigint as n_sentences,
        list_filter(list_transform(s, lambda x: by_text[x]), lambda x: x is not null) as ids from t, m),
l as (select *, ';' || coalesce(array_to_string(ids, ';'), '') || ';' as line from i),
h as (select *, list_distinct(list_filter([{hits}], lambda x: x is not null)) as found from l)
select doc_id, n_sentences, len(ids)::bigint as n_known, coalesce(array_to_string(ids, ';'), '') as sequence,
  coalesce(array_to_string(list_filter([{order}], lambda x: list_contains(found, x)), ','), '') as licenses from h
"""
