"""License scans by sentence rules: sentences are normalised and mapped to identifiers of known license sentences; the
sequence of identifiers of a text is then matched against ordered license rules.

Normalised: letters A-Z in lower case, every other run of signs than a-z and 0-9 one space. A break is a line's end, or one of
. ! ? : ; before white space or the text's end. A known sentence is found where its words follow each other between two
breaks; breaks inside it don't matter, so wrapped lines and comment marks at their starts do no harm. <name> in a sentence
stands for one to twelve words. Of sentences that start at the same break the longest is taken, and none reach into each other.
Unknown sentences are skipped. A rule is a sequence of identifiers; it holds if they follow each other in the text's
sequence. Rules are tried in order, longest first, and each takes the identifiers it matched away from later ones, so that
no license is reported for a part of another one's text. A rule reports its license once.

Only texts that hold a word of HINT are normalised; every known sentence has one of them, in one piece (tested), so no other
text can match. A null or empty text has no sentences; very long texts are matched whole. Ties do not arise, repeated rows
give repeated results, an empty table an empty one. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.llm.tables import read

#: Known license sentences, normalised, by identifier.
SENTENCES = {
    "mit-name": "released under the mit license",
    "mit-name2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-name": "licensed under the apache license version 2 0",
    "apache-name2": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-name": "this work is licensed under the gnu general public license version 3",
    "gpl3-name2": "licensed under the gnu general public license version 3",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl3-name": "licensed under the gnu lesser general public license version 3",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of <name> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd3-name": "released under the bsd 3 clause license",
    "bsd2-name": "released under the bsd 2 clause license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "ccby4-name": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccby4-name2": "licensed under cc by 4 0",
    "ccbysa4-name": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0-name": "this work is dedicated to the public domain under the cc0 1 0 universal license",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "apache-terms": "terms and conditions for use reproduction and distribution",
    "apache-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "gpl3-copy": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl3-preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-name": "licensed under the gnu affero general public license version 3",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-style": "use of this source code is governed by a bsd style license that can be found in the license file",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-name": "distributed under the boost software license version 1 0",
    "ccbync4-name": "licensed under cc by nc 4 0",
    "ccbysa4-name2": "licensed under cc by sa 4 0",
    "wtfpl-grant": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
}
#: Licenses with a tag line (SPDX-License-Identifier: id), whose sentence is made by rule.
TAGS = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense", "Zlib", "BSL-1.0", "0BSD"]
SENTENCES |= {f"tag-{t.lower()}": "spdx license identifier " + t.lower().replace("-", " ").replace(".", " ") for t in TAGS}

#: License rules, in the order in which they are tried.
RULES = [
    ("MIT", "full", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("Apache-2.0", "notice", ["apache-name2", "apache-use", "apache-copy", "apache-warranty", "apache-see"]),
    ("Apache-2.0", "notice", ["apache-name2", "apache-use"]),
    ("Apache-2.0", "full", ["apache-terms", "apache-grant"]),
    ("GPL-3.0-or-later", "notice", ["gpl3-free", "gpl-warranty", "gpl-see", "gpl-received"]),
    ("GPL-2.0-or-later", "notice", ["gpl2-free", "gpl-warranty", "gpl-see", "gpl-received"]),
    ("AGPL-3.0-or-later", "notice", ["agpl3-free", "gpl-warranty"]),
    ("GPL-3.0-or-later", "notice", ["gpl3-free", "gpl-warranty"]),
    ("GPL-2.0-or-later", "notice", ["gpl2-free", "gpl-warranty"]),
    ("BSD-3-Clause", "full", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "full", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", "full", ["isc-grant"]),
    ("MIT", "name", ["mit-name"]),
    ("MIT", "name", ["mit-name2"]),
    ("MIT", "part", ["mit-grant"]),
    ("MIT", "part", ["mit-notice", "mit-warranty"]),
    ("Apache-2.0", "name", ["apache-name"]),
    ("Apache-2.0", "name", ["apache-name2"]),
    ("GPL-3.0-only", "name", ["gpl3-name"]),
    ("GPL-3.0-only", "name", ["gpl3-name2"]),
    ("GPL-3.0-or-later", "part", ["gpl3-free"]),
    ("GPL-2.0-or-later", "part", ["gpl2-free"]),
    ("LGPL-3.0-only", "name", ["lgpl3-name"]),
    ("BSD-3-Clause", "name", ["bsd3-name"]),
    ("BSD-2-Clause", "name", ["bsd2-name"]),
    ("MPL-2.0", "notice", ["mpl2-form"]),
    ("CC-BY-4.0", "name", ["ccby4-name"]),
    ("CC-BY-4.0", "name", ["ccby4-name2"]),
    ("CC-BY-SA-4.0", "name", ["ccbysa4-name"]),
    ("CC0-1.0", "name", ["cc0-name"]),
    ("Unlicense", "notice", ["unlicense-free"]),
    ("AGPL-3.0-or-later", "part", ["agpl3-free"]),
    ("LGPL-2.1-or-later", "notice", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", "notice", ["lgpl3-free"]),
    ("AGPL-3.0-only", "name", ["agpl3-name"]),
    ("GPL-3.0-only", "full", ["gpl3-copy", "gpl3-preamble"]),
    ("EPL-2.0", "notice", ["epl2-terms"]),
    ("BSD-3-Clause", "style", ["bsd-style"]),
    ("Zlib", "full", ["zlib-grant"]),
    ("BSL-1.0", "name", ["boost-name"]),
    ("CC-BY-NC-4.0", "name", ["ccbync4-name"]),
    ("CC-BY-SA-4.0", "name", ["ccbysa4-name2"]),
    ("WTFPL", "full", ["wtfpl-grant"]),
    *[(t, "tag", [f"tag-{t.lower()}"]) for t in TAGS],
]

#: Every known sentence holds one of these.
HINT = r"(?i)licen[sc]e|copyright|warrant|redistribut|permission|unencumbered|liable|boost|distribution"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = " / "
GAP = "(?: /)* "
NAME = f"[a-z0-9]+(?:{GAP}[a-z0-9]+){{0,11}}?"


def _pattern(sentence: str) -> str:
    return sentence.replace(" ", GAP).replace("<name>", NAME)


#: Longest first, as of sentences that start alike the longest is meant. Breaks are written twice, so that each match has its own.
KNOWN = "/ (" + "|".join(_pattern(x) for x in sorted(SENTENCES.values(), key=lambda x: (-len(x), x))) + ") /"


#: Possessive, as Java's patterns otherwise call themselves once for each break of a run and overflow the stack on long ones.
RUN_OF_BREAKS = " *+(?:/ *+)++"


def normalised(text: Column) -> Column:
    """The words of a text, with / at each break, at the start and at the end."""
    kept = F.regexp_replace(F.translate(text, UPPER, LOWER), r"[^a-z0-9.!?:;\n]+", " ")
    broken = F.regexp_replace(kept, r"[.!?:;]+(?:[ \n]|$)|\n", BREAK)
    words = F.regexp_replace(broken, "[^a-z0-9/]+", " ")
    return F.regexp_replace(F.concat(F.lit(BREAK), words, F.lit(BREAK)), RUN_OF_BREAKS, BREAK)


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    plain = {v: k for k, v in SENTENCES.items() if "<name>" not in v}
    known = F.create_map(*[F.lit(x) for v, k in plain.items() for x in (v, k)])
    slots = [(k, *v.split("<name>")) for k, v in SENTENCES.items() if "<name>" in v]

    def named(found: Column) -> Column:
        words = F.replace(found, F.lit(" /"), F.lit(""))
        return F.coalesce(F.try_element_at(known, words), *[F.when(words.startswith(a) & words.endswith(b), F.lit(k)) for k, a, b in slots])

    twice = F.replace(normalised(text), F.lit(BREAK), F.lit(" / / "))
    found = F.transform(F.regexp_extract_all(twice, F.lit(KNOWN), F.lit(1)), named)
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def matched_licenses(ids: Column) -> Column:
    """Each rule in turn takes what it matches out of the sequence."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|" + "|".join(seq) + "|").alias("seq")) for name, _, seq in RULES])
    start = F.struct(F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|")).alias("left"), F.array().cast("array<string>").alias("names"))

    def tried(state: Column, rule: Column) -> Column:
        seq = F.replace(rule["seq"], F.lit("|"), F.lit("||"))
        seq = F.substr(seq, F.lit(2), F.length(seq) - 2)
        hit = F.contains(state["left"], seq)
        left = F.when(hit, F.replace(state["left"], seq, F.lit("|*|"))).otherwise(state["left"])
        names = F.when(hit, F.array_append(state["names"], rule["name"])).otherwise(state["names"])
        return F.struct(left.alias("left"), names.alias("names"))

    none = F.array().cast("array<string>")
    return F.when(F.size(ids) == 0, none).otherwise(F.array_distinct(F.aggregate(rules, start, tried)["names"]))


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """row (all columns of df), sentence_ids and licenses."""
    out = df.select(F.struct("*").alias("row")).withColumn("sentence_ids", sentence_ids(F.coalesce(F.col("row")[text], F.lit(""))))
    return out.withColumn("licenses", matched_licenses(F.col("sentence_ids")))


def op9_license_scans(spark, sf_dir):
    out = scanned(read(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    """By words and breaks: a sentence of n words holds where n words between two breaks are its own. No pattern over texts."""
    known = ", ".join(f"('{k}', '{v}', {len(v.split())})" for k, v in SENTENCES.items() if "<name>" not in v)
    for k, v in SENTENCES.items():
        if "<name>" in v:
            known += "".join(f", ('{k}', '{v.replace('<name>', '%')}', {len(v.split()) + n})" for n in range(12))
    rules = ", ".join(f"({i}, '{name}', '|{'||'.join(seq)}|')" for i, (name, _, seq) in enumerate(RULES))
    return rf"""
WITH RECURSIVE known(id, sentence, n) AS (VALUES {known}), rules(k, name, seq) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, regexp_replace(regexp_replace(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9.!?:;
]+', ' ', 'g'), '[.!?:;]+([ 
]|$)|
', ' / ', 'g'), '[^a-z0-9/]+', ' ', 'g') AS x FROM d WHERE regexp_matches(lower(text), 'licen|copyright|warrant|redistribut|permission|unencumbered|liable|boost|distribution')),
w AS (SELECT r, list_filter(string_split(x, ' '), lambda v: v <> '') AS all_words FROM p),
b AS (SELECT r, list_filter(all_words, lambda v: v <> '/') AS words,
  list_distinct(list_transform(list_filter(generate_series(1, len(all_words)), lambda j: all_words[j] = '/'), lambda j: len(list_filter(all_words[1:j], lambda v: v <> '/')))) AS breaks FROM w),
starts AS (SELECT r, words, len(words) AS n_words, breaks, unnest(list_distinct(list_append(breaks, 0))) AS i FROM b),
f AS (SELECT r, i, id, n FROM starts JOIN (SELECT DISTINCT n AS m FROM known) ON i + m <= n_words AND (i + m = n_words OR list_contains(breaks, i + m)) JOIN known ON known.n = m AND array_to_string(words[i + 1:i + m], ' ') LIKE sentence),
s AS (SELECT r, string_agg(id, ',' ORDER BY i) AS ids, count(*) AS n, '|' || string_agg(id, '||' ORDER BY i) || '|' AS seq FROM (SELECT r, i, arg_max(id, n) AS id FROM f GROUP BY r, i) GROUP BY r),
t AS (SELECT r, 0 AS k, seq AS left_over, [] :: VARCHAR[] AS names FROM s
  UNION ALL SELECT r, t.k + 1, replace(left_over, rules.seq, '|*|'), CASE WHEN contains(left_over, rules.seq) THEN list_append(names, name) ELSE names END FROM t JOIN rules ON rules.k = t.k),
m AS (SELECT r, array_to_string(list_filter(names, lambda v, j: list_position(names, v) = j), ',') AS licenses FROM t WHERE k = {len(RULES)})
SELECT doc_id, coalesce(s.n, 0)::BIGINT AS n_sentences, coalesce(s.ids, '') AS sentence_ids, coalesce(m.licenses, '') AS licenses FROM d LEFT JOIN s USING (r) LEFT JOIN m USING (r)
"""


OP9_SQL = _sql()
