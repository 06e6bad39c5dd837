"""License scans by ordered signature rules.

Rules are regular expressions over a text's words. A keyword in the words admits a text, and then the
rules that name this keyword. Detections carry their rule's priority; one whose interval lies within
that of another of higher priority, or of equal priority and greater length, is suppressed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases that are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Families: label, a keyword any mention has, patterns of its names (a pair where a pattern has another
#: keyword), identifiers, versions. A rule is tried only on texts with its keyword: every match must contain it.
FAMILIES = [
    ("agpl", "affero", [r"gnu affero general public licen[sc]e", r"affero general public licen[sc]e"], ["agpl", "agplv3"], ["3 0", "3", "1 0"]),
    ("lgpl", "lesser", [(r"gnu (?:lesser|library) general public licen[sc]e", "gnu"), r"lesser general public licen[sc]e"], ["lgpl", "lgplv2", "lgplv3"], ["3 0", "3", "2 1", "2 0", "2"]),
    ("gpl", "gnu", [r"gnu general public licen[sc]e", r"gnu public licen[sc]e", r"gnu gpl"], ["gpl", "gplv2", "gplv3"], ["3 0", "3", "2 0", "2", "1 0"]),
    ("gfdl", "documentation", [r"gnu free documentation licen[sc]e"], ["gfdl"], ["1 3", "1 2", "1 1"]),
    ("apache", "apache", [r"apache (?:software )?licen[sc]e", r"apache software foundation licen[sc]e"], ["apache", "asl"], ["2 0", "2", "1 1", "1 0"]),
    ("mit", "mit", [r"mit licen[sc]e", r"mit x11 licen[sc]e", (r"expat licen[sc]e", "expat")], ["mit", "mit 0"], []),
    ("bsd", "bsd", [r"(?:[234] clause |new |modified |simplified |revised )?bsd licen[sc]e", r"bsd style licen[sc]e"], ["bsd", "0bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause"], []),
    ("mpl", "mozilla", [r"mozilla public licen[sc]e"], ["mpl"], ["2 0", "1 1", "1 0"]),
    ("epl", "eclipse", [r"eclipse public licen[sc]e"], ["epl"], ["2 0", "1 0"]),
    ("eupl", "european", [r"european union public licen[sc]e"], ["eupl"], ["1 2", "1 1"]),
    ("cddl", "distribution", [r"common development and distribution licen[sc]e"], ["cddl"], ["1 1", "1 0"]),
    ("cpl", "common", [r"common public licen[sc]e"], ["cpl"], ["1 0"]),
    ("artistic", "artistic", [r"(?:perl )?artistic licen[sc]e"], ["artistic"], ["2 0", "1 0"]),
    ("bsl", "boost", [r"boost software licen[sc]e"], ["bsl"], ["1 0"]),
    ("isc", "isc", [r"isc licen[sc]e"], ["isc"], []),
    ("zlib", "zlib", [r"zlib(?: libpng)? licen[sc]e"], ["zlib"], []),
    ("unlicense", "unlicense", [r"the unlicense"], ["unlicense"], []),
    ("wtfpl", "wtfpl", [(r"do what the f\w* you want to public licen[sc]e", "want")], ["wtfpl"], ["2"]),
    ("python", "python", [r"python software foundation licen[sc]e", r"python licen[sc]e"], ["psf", "python"], ["2 0", "2"]),
    ("php", "php", [r"php licen[sc]e"], ["php"], ["3 01", "3 0"]),
    ("ofl", "font", [r"(?:sil )?open font licen[sc]e"], ["ofl"], ["1 1", "1 0"]),
    ("odbl", "database", [r"open database licen[sc]e", (r"open data commons(?: open database licen[sc]e)?", "data")], ["odbl"], ["1 0"]),
    ("ms-pl", "microsoft", [r"microsoft public licen[sc]e", r"microsoft reciprocal licen[sc]e"], ["ms pl", "ms rl"], []),
    ("openssl", "openssl", [r"openssl licen[sc]e"], ["openssl"], []),
    ("postgresql", "postgresql", [r"postgresql licen[sc]e"], ["postgresql"], []),
    ("cc-by-nc-sa", "creative", [r"creative commons attribution non ?commercial share ?alike"], ["cc by nc sa"], ["4 0", "3 0", "2 5", "2 0"]),
    ("cc-by-nc-nd", "creative", [r"creative commons attribution non ?commercial no ?deriv\w*"], ["cc by nc nd"], ["4 0", "3 0", "2 5", "2 0"]),
    ("cc-by-nc", "creative", [r"creative commons attribution non ?commercial"], ["cc by nc"], ["4 0", "3 0", "2 5", "2 0"]),
    ("cc-by-sa", "creative", [r"creative commons attribution share ?alike"], ["cc by sa"], ["4 0", "3 0", "2 5", "2 0"]),
    ("cc-by-nd", "creative", [r"creative commons attribution no ?deriv\w*"], ["cc by nd"], ["4 0", "3 0", "2 5", "2 0"]),
    ("cc-by", "creative", [r"creative commons attribution"], ["cc by"], ["4 0", "3 0", "2 5", "2 0"]),
    ("cc0", "cc0", [r"cc0", (r"creative commons zero", "creative")], ["cc0"], ["1 0"]),
]

#: How a license is granted or named around its name, with priority: NAME stands for a name and its version.
FRAMES = [
    (r"(?:this \w+ (?:is|are) )?(?:dual )?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?NAME", 90),
    (r"(?:is |are )?(?:released|available|published|provided|distributed|redistributed) under (?:the )?(?:terms of (?:the )?)?NAME", 85),
    (r"under (?:the )?(?:terms|conditions) of (?:the )?NAME", 80),
    (r"subject to (?:the )?(?:terms of (?:the )?)?NAME", 75),
    (r"NAME", 60),
]


#: What the texts and headers of licenses say, by hand: label, a keyword of every match, pattern, priority.
BODIES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 88),
    ("mit", "permission", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions", 72),
    ("mit-0", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 89),
    ("bsl", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 88),
    ("isc", "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 88),
    ("0bsd", "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided", 89),
    ("ntp", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose", 84),
    ("ofl", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of the font software", 88),
    ("unicode", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 88),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 86),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 70),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 70),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:the )?(?:\S+ ){1,12}nor the names of (?:its|the) contributors may be used to endorse or promote products", 87),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 87),
    ("apache", "compliance", r"you may not use this (?:file|work|software) except in compliance with the license", 78),
    ("apache", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the (?:apache )?license", 74),
    ("apache", "grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", 76),
    ("apache", "apache", r"this product includes software developed (?:by|at) the apache (?:software foundation|group)", 70),
    ("gpl", "redistribute", r"is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 92),
    ("lgpl", "redistribute", r"is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", 93),
    ("agpl", "redistribute", r"is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", 93),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public licen[sc]e", 82),
    ("lgpl", "gnu", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 83),
    ("agpl", "gnu", r"you should have received a copy of the gnu affero general public licen[sc]e", 83),
    ("gpl", "copyleft", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", 91),
    ("gpl", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it", 84),
    ("gfdl", "cover", r"with no invariant sections no front cover texts and no back cover texts", 86),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e", 92),
    ("mpl", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 90),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 92),
    ("cddl", "development", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 92),
    ("cc0", "neighboring", r"(?:has waived|waives) all copyright and related or neighboring rights", 86),
    ("cc-by", "attribution", r"this work is licensed under (?:a |the )?creative commons attribution(?: \d)?", 88),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 90),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 86),
    ("zlib", "implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 84),
    ("artistic", "artistic", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", 88),
    ("wtfpl", "want", r"you just do what the f\w* you want to", 86),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 86),
    ("postgresql", "documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 90),
    ("python", "psf", r"psf is making python available to licensee on an as is basis", 88),
    ("php", "php", r"this product includes php software freely available from", 86),
    ("beerware", "retain", r"as long as you retain this notice you can do whatever you want with this stuff", 86),
    ("json", "evil", r"the software shall be used for good not evil", 88),
    ("sleepycat", "sleepycat", r"sleepycat (?:software|licen[sc]e)", 60),
    ("vim", "vim", r"vim licen[sc]e", 60),
    ("ruby", "ruby", r"ruby s licen[sc]e|ruby licen[sc]e", 60),
    ("ecl", "educational", r"educational community licen[sc]e", 60),
    ("osl", "open", r"open software licen[sc]e", 60),
    ("afl", "academic", r"academic free licen[sc]e", 60),
    ("qpl", "public", r"q public licen[sc]e", 60),
    ("sspl", "server", r"server side public licen[sc]e", 60),
    ("busl", "business", r"business source licen[sc]e", 60),
    ("elastic", "elastic", r"elastic licen[sc]e", 60),
    ("upl", "universal", r"universal permissive licen[sc]e", 60),
    ("cecill", "cecill", r"cecill(?: [abc])? (?:free software )?licen[sc]e", 60),
    ("openrail", "responsible", r"responsible ai licen[sc]e", 60),
    ("llama", "llama", r"llama (?:\d )?community licen[sc]e", 60),
    ("disclaimer", "warranty", r"without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", 35),
    ("disclaimer", "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 35),
    ("disclaimer", "contributors", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties", 35),
    ("all-rights-reserved", "rights", r"all rights reserved", 40),
    ("proprietary", "proprietary", r"proprietary and confidential", 45),
    ("proprietary", "without", r"may not be (?:copied|distributed|reproduced) without", 45),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document)", 45),
    ("proprietary", "trade", r"contains? (?:confidential information and )?trade secrets of", 45),
    ("public-domain", "domain", r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", 70),
    ("copyright-notice", "copyright", r"copyright (?:c )?(?:19|20)\d\d", 30),
]


@dataclass(frozen=True)
class Signature:
    number: int
    label: str
    keyword: str
    regex: str
    priority: int


def signatures() -> list[Signature]:
    """All rules, in order: families x (frames x names, identifiers with versions, SPDX tags), and what is said by hand."""
    made: list[tuple[str, str, str, int]] = []
    for label, keyword, names, ids, versions in FAMILIES:
        number = "|".join(re.escape(v).replace(r"\ ", " ") for v in versions)
        version = rf"(?: (?:version |v ?)?(?:{number}))?(?: or (?:any )?later(?: version)?)?(?: international| unported)?" if versions else ""
        for entry in names:
            name, word = (entry, keyword) if isinstance(entry, str) else entry
            for frame, priority in FRAMES:
                made.append((label, word, frame.replace("NAME", name + version), priority))
        for short in ids:
            first = short.split()[0]
            made.append((label, "spdx", rf"spdx licen[sc]e identifier {short}{version}(?: only)?", 100))
            made.append((label, first, rf"licen[sc]ed under (?:the )?{short}{version}(?: licen[sc]e)?", 95))
            made.append((label, first, rf"licen[sc]e {short}{version}", 55))
            if versions:
                made += [(label, first, rf"{short} (?:version |v ?)?{v}", 65) for v in versions]
    made += BODIES
    return [Signature(i, label, keyword, f"(?<= )(?:{regex})(?= )", priority) for i, (label, keyword, regex, priority) in enumerate(made)]


#: Words of which any detection or counted phrase has one. `mit` alone is a common German word.
ADMITTING = "license licence licensed licenced licenses licences spdx cc cc0 creative unlicense rights proprietary domain copyright agpl agplv3 lgpl lgplv2 lgplv3 gpl gplv2 gplv3 gfdl asl apache mpl epl eupl cddl cpl artistic bsl wtfpl psf php python ofl odbl open without permission redistribution redistributions endorse advertising compliance grants copyleft freedom cover neighboring unencumbered altered implied want openssl documentation applicable retain evil sleepycat unauthorized trade warranty merchantability contributors conditions".split()
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, for comparison with ASCII words; letters beyond ASCII may change to others beyond it.

    The Kelvin sign is the only one of them that `lower` turns to an ASCII word.
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))


def starts(phrase: str) -> Column:
    """Numbers of the words at which the phrase begins, in column `words`."""
    parts = phrase.split()
    words = F.col("words")
    places = F.when(F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts))).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        out = words[i] == parts[0]
        for k, w in enumerate(parts[1:], 1):
            out = out & (words[i + k] == w)
        return out

    return F.filter(places, here)


#: Stand before and after a match in a text; no word has them.
OPEN, SHUT = "\x01", "\x02"
FOUND = "struct<start:int,end:int,priority:int,number:int,label:string>"


def detections(norm: Column, keywords: Column, rules: list[Signature]) -> Column:
    """Array of struct(start, end, priority, number, label) of all matches of the admitted rules, in words from 0.

    A match is whole words between single spaces: marked in the text, it is found again by the numbers of
    its first and last words, in time that grows with the text.
    """
    table = F.from_json(F.lit(json.dumps([asdict(r) for r in rules])), "array<struct<number:int,label:string,keyword:string,regex:string,priority:int>>")
    admitted = F.filter(table, lambda r: F.array_contains(keywords, r["keyword"]))

    def places(words: Column, mark: Callable[[Column], Column]) -> Column:
        return F.array_compact(F.transform(words, lambda w, i: F.when(mark(w), i)))

    def found(r: Column) -> Column:
        def spans(words: Column) -> Column:
            pairs = F.arrays_zip(places(words, lambda w: w.startswith(OPEN)).alias("0"), places(words, lambda w: w.endswith(SHUT)).alias("1"))
            return F.transform(pairs, lambda p: F.struct(p["0"].alias("start"), (p["1"] + 1).alias("end"), r["priority"].alias("priority"), r["number"].alias("number"), r["label"].alias("label")))

        # a lambda's argument is worked out once, however often it is used
        return F.transform(F.array(F.split(F.trim(F.regexp_replace(norm, r["regex"], F.lit(f"{OPEN}$0{SHUT}"))), " ")), spans)[0]

    present = F.filter(admitted, lambda r: F.regexp_like(norm, r["regex"]))
    return F.flatten(F.transform(present, found))


def unsuppressed(found: Column, levels: list[int]) -> Column:
    """Detections that lie in no stronger one, by one sweep.

    Stronger: of higher priority, or of equal priority and wider, or the same place by an earlier rule.
    In the order of start, end descending, priority descending and number, all that can suppress a
    detection come before it, so the largest end so far of its own and of each higher priority decides.
    """
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("less"), (-d["priority"]).alias("rank"), d["number"].alias("number"), d["label"].alias("label"))))
    ends = F.array(*[F.lit(-1)] * len(levels))
    state = F.struct(ends.alias("ends"), F.array().cast(f"array<{FOUND}>").alias("out"))
    high = F.array(*map(F.lit, levels))

    def step(acc: Column, d: Column) -> Column:
        beaten = F.exists(F.arrays_zip(acc["ends"].alias("end"), high.alias("level")), lambda x: (x["level"] >= -d["rank"]) & (x["end"] >= -d["less"]))
        one = F.array(F.struct(d["start"].alias("start"), (-d["less"]).alias("end"), (-d["rank"]).alias("priority"), d["number"].alias("number"), d["label"].alias("label")))
        reached = F.transform(F.arrays_zip(acc["ends"].alias("end"), high.alias("level")), lambda x: F.when(x["level"] == -d["rank"], F.greatest(x["end"], -d["less"])).otherwise(x["end"]))
        return F.struct(reached.alias("ends"), F.when(beaten, acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(order, state, step)["out"]


def license_scan(docs: DataFrame, rules: list[Signature] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections: array of struct(start, end, priority, number, label); words from 0, end exclusive. labels: of the detections and the counted phrases. score: the highest
    priority of a detection in hundredths, 0 without one. Null texts are empty; repeated rows and null ids
    stay; an empty table gives an empty result; other columns are not read. One projection: no shuffle.
    """
    rules = signatures() if rules is None else rules
    docs = docs.select(F.col(id_col).alias("id"), F.array_remove(F.split(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), NOT_WORD), "").alias("words"))
    admitted = F.arrays_overlap("words", F.split(F.lit(" ".join(ADMITTING)), " "))
    docs = docs.select("id", F.size("words").cast("bigint").alias("n_words"), F.when(admitted, F.col("words")).alias("words"))
    every = sorted({r.keyword for r in rules})
    norm = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    places = [F.when(F.col("words").isNotNull(), starts(p)).alias(f"at{i}") for i, p in enumerate(PHRASES)]
    docs = docs.select("id", "n_words", *places, F.when(F.col("words").isNotNull(), norm).alias("norm"), F.when(F.col("words").isNotNull(), F.array_intersect(F.split(F.lit(" ".join(every)), " "), "words")).alias("keywords"))
    docs = docs.withColumn("found", F.when(F.col("norm").isNotNull(), detections(F.col("norm"), F.col("keywords"), rules)))
    docs = docs.withColumn("found", F.when(F.size("found") > 0, unsuppressed(F.col("found"), sorted({r.priority for r in rules}))))
    at = [F.col(f"at{i}") for i in range(len(PHRASES))]
    some = [F.when(a.isNull(), 0).otherwise(F.size(a)) for a in at]
    base = F.array_sort(F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for n, label in zip(some, PHRASES.values(), strict=True)])))
    names = F.coalesce(F.transform("found", lambda d: d["label"]), F.array().cast("array<string>"))
    return docs.select(
        F.col("id").alias(id_col),
        "n_words",
        sum(some[1:], some[0]).cast("bigint").alias("n_base"),
        F.least(*[F.array_min(a) for a in at]).cast("bigint").alias("first_word"),
        F.greatest(*[F.array_max(a) for a in at]).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, names))), ",").alias("labels"),
        (F.coalesce(F.array_max(F.transform("found", lambda d: d["priority"])), F.lit(0)) / F.lit(100.0)).alias("score"),
        F.coalesce("found", F.array().cast(f"array<{FOUND}>")).alias("detections"),
    )
