"""License scans by ordered signature rules (DataFrame functions only).

A text becomes its words, lower-cased and joined by single spaces. A coarse gate of
substrings that every rule needs lets most texts go by after one pass; the others
get the keyword prefilter (only rules whose keyword stands in the text are tried)
and then the rules' regular expressions. A detection is an interval of words. In
the order (start, longest first, priority) each detection is dropped that lies within
an earlier one whose priority is as good. All of that is expressions on one row: no
shuffle, no Python, nothing gathered from other rows, and no step whose time grows
with the square of a text's matches.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are labelled wherever they stand (fixed by the contract).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Every rule's matches hold one of these.
GATE = (
    "licen", "gpl", " cc by", " cc0 ", "creative commons", "creativecommons", "public domain", "copyleft", " bsd 2 clause", " bsd 3 clause", " bsd 4 clause",
    "permission is hereby granted", "redistribution and use in source", "permission to use copy modify", "this program is free software", "this library is free software",
    "without any express or implied warranty", "subject to the terms of the mozilla", "boost org",
)

# Families of licenses. (label, written names, short forms, versions)
FAMILIES = [
    ("gpl", "gnu general public licen[cs]e|gnu gpl", "gpl", "1 0|2 0|3 0"),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e|gnu lgpl", "lgpl", "2 0|2 1|3 0"),
    ("agpl", "(?:gnu )?affero general public licen[cs]e|gnu agpl", "agpl", "1 0|3 0"),
    ("gfdl", "gnu free documentation licen[cs]e", "gfdl licen[cs]e", "1 1|1 2|1 3"),
    ("apache", "apache (?:software )?licen[cs]e", "asl licen[cs]e", "1 0|1 1|2 0"),
    ("mpl", "mozilla public licen[cs]e", "mpl licen[cs]e", "1 0|1 1|2 0"),
    ("epl", "eclipse public licen[cs]e", "epl licen[cs]e", "1 0|2 0"),
    ("eupl", "european union public licen[cs]e", "eupl licen[cs]e", "1 0|1 1|1 2"),
    ("cddl", "common development and distribution licen[cs]e", "cddl licen[cs]e", "1 0|1 1"),
    ("cpl", "common public licen[cs]e", "cpl licen[cs]e", "1 0"),
    ("artistic", "artistic licen[cs]e", "perl artistic licen[cs]e", "1 0|2 0"),
    ("afl", "academic free licen[cs]e", "afl licen[cs]e", "1 1|1 2|2 0|2 1|3 0"),
    ("osl", "open software licen[cs]e", "osl licen[cs]e", "1 0|1 1|2 0|2 1|3 0"),
    ("cecill", "cecill (?:free software )?licen[cs]e", "licen[cs]e cecill", "1 0|1 1|2 0|2 1"),
    ("ofl", "(?:sil )?open font licen[cs]e", "ofl licen[cs]e", "1 0|1 1"),
    ("odbl", "open database licen[cs]e", "odbl licen[cs]e", "1 0"),
    ("boost", "boost software licen[cs]e", "bsl licen[cs]e", "1 0"),
    ("psf", "python software foundation licen[cs]e", "psf licen[cs]e", "2 0"),
    ("php", "php licen[cs]e", "licen[cs]e php", "3 0|3 01"),
    ("zpl", "zope public licen[cs]e", "zpl licen[cs]e", "1 1|2 0|2 1"),
    ("lppl", "latex project public licen[cs]e", "lppl licen[cs]e", "1 0|1 1|1 2|1 3"),
    ("qpl", "q public licen[cs]e", "qpl licen[cs]e", "1 0"),
    ("apsl", "apple public source licen[cs]e", "apsl licen[cs]e", "1 0|1 1|1 2|2 0"),
    ("ecl", "educational community licen[cs]e", "ecl licen[cs]e", "1 0|2 0"),
    ("upl", "universal permissive licen[cs]e", "upl licen[cs]e", "1 0"),
    ("bsl", "business source licen[cs]e", "busl licen[cs]e", "1 1"),
    ("sspl", "server side public licen[cs]e", "sspl licen[cs]e", "1 0"),
    ("ms-pl", "microsoft public licen[cs]e", "ms pl licen[cs]e", ""),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "ms rl licen[cs]e", ""),
    ("mit", "mit licen[cs]e", "expat licen[cs]e", ""),
    ("isc", "isc licen[cs]e", "licen[cs]e isc", ""),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "libpng licen[cs]e", ""),
    ("ncsa", "university of illinois (?:ncsa )?open source licen[cs]e", "ncsa licen[cs]e", ""),
    ("x11", "x11 licen[cs]e", "licen[cs]e x11", ""),
    ("w3c", "w3c software (?:notice and )?licen[cs]e", "w3c licen[cs]e", ""),
    ("postgresql", "postgresql licen[cs]e", "licen[cs]e postgresql", ""),
    ("openssl", "openssl licen[cs]e", "ssleay licen[cs]e", ""),
    ("ruby", "ruby licen[cs]e", "same licen[cs]e as ruby", ""),
    ("perl", "perl licen[cs]e", "same licen[cs]e as perl(?: itself)?", ""),
    ("sleepycat", "sleepycat licen[cs]e", "berkeley db licen[cs]e", ""),
    ("vim", "vim licen[cs]e", "licen[cs]e vim", ""),
    ("unlicense", "the unlicense", "unlicense", ""),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "wtfpl licen[cs]e", ""),
    ("beerware", "beerware licen[cs]e", "beer ware licen[cs]e", ""),
    ("json", "json licen[cs]e", "licen[cs]e json", ""),
    ("curl", "curl licen[cs]e", "licen[cs]e curl", ""),
    ("icu", "icu licen[cs]e", "unicode licen[cs]e", ""),
    ("0bsd", "zero clause bsd licen[cs]e", "0bsd licen[cs]e", ""),
]
# Rules that no family gives. (label, expression, score)
SINGLE = [
    ("bsd-2-clause", "(?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?", 0.9),
    ("bsd-3-clause", "(?:modified|new|revised|3 clause|three clause) bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?", 0.9),
    ("bsd-4-clause", "(?:original|4 clause|four clause) bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?", 0.9),
    ("bsd", "bsd(?: style)? licen[cs]e", 0.7),
    # notices that stand in a file instead of a license's name
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 1.0),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?", 1.0),
    ("zlib", "this software is provided as is without any express or implied warranty(?: in no event will the authors be held liable)?", 0.8),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 1.0),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", 1.0),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", 1.0),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[cs]e v ?2 0", 1.0),
    ("apache-2.0", "licensed under the apache licen[cs]e version 2 0(?: the licen[cs]e)? you may not use this file except in compliance with the licen[cs]e", 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1.0),
    ("boost-1.0", "(?:www )?boost org license 1 0 txt", 1.0),
    ("apache-2.0", "apache org licenses license 2 0", 1.0),
    ("mit", "opensource org licenses mit(?: license)?", 1.0),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause", 1.0),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause", 1.0),
    ("cc0-1.0", "creativecommons org (?:publicdomain|licenses) zero 1 0", 1.0),
    ("cc0-1.0", "cc0(?: 1 0)?(?: universal)?(?: licen[cs]e)?", 0.8),
    ("cc0-1.0", "creative commons (?:zero|cc0)(?: v?1 0)?(?: universal)?", 0.9),
    ("cc", "(?:a |under )?creative commons(?: licen[cs]e)?", 0.5),
    ("public-domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain|in the public domain|public domain dedication", 0.7),
    ("copyleft", "copyleft(?: licen[cs]e)?", 0.4),
    ("proprietary", "proprietary licen[cs]e", 0.5),
    ("license-notice", "(?:is |are )?licensed under(?: the)?(?: terms of(?: the)?)?", 0.3),
    ("license-notice", "see (?:the )?license(?: file)? for (?:the )?(?:specific language|details|more information)", 0.3),
    ("license-notice", "all rights reserved(?: [^ ]+){0,12}? licen[cs]e", 0.3),
]
CC_KINDS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ate)?s(?: works)?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


#: Words that say nothing about which license it is.
COMMON_WORDS = frozenset("license public software the a free open source general licenses org under".split())


def keyword(pattern: str) -> str:
    """The most telling literal stretch that every match of a pattern without top-level alternatives must hold."""
    depth, runs, run = 0, [], ""
    for i, ch in enumerate(pattern):
        depth += (ch == "(") - (ch == ")")
        after = pattern[i + 1 : i + 2]
        if depth == 0 and (ch.isalnum() or ch == " ") and after not in ("?", "*", "{"):
            run += ch
        else:
            runs.append(run)
            run = ""
    runs.append(run)
    telling = lambda r: sum(len(w) for w in r.split() if w not in COMMON_WORDS) + len(r) / 100
    return max(runs, key=telling)


def alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a pattern."""
    depth, out = 0, [""]
    for ch in pattern:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return out


def rules() -> list[dict]:
    """All rules in order: label, keyword, expression over words joined by spaces, priority (1 is best), score.

    "licence" has become "license" before a rule sees a text.
    """
    out: list[dict] = []

    def add(label: str, pattern: str, priority: int, score: float) -> None:
        for one in alternatives(pattern.replace("licen[cs]e", "license")):
            out.append({"label": label, "keyword": keyword(one), "pattern": f" (?:{one})(?= )", "priority": priority, "score": score})

    def version(v: str) -> str:  # "2 0": 2.0, 2, v2
        major, minor = v.split()
        return f"(?:v?{major} {minor}" + (f"|v?{major}(?! [0-9]))" if minor == "0" else ")")

    for label, names, short, versions in FAMILIES:
        tag = label.replace("-", " ")
        for v in filter(None, versions.split("|")):
            full = f"{label}-{v.replace(' ', '.')}"
            add(full, f"spdx license identifier {tag} {v}(?: only| or later)?", 1, 1.0)
            for name in alternatives(names):
                add(full, f"{name}(?: as published by the free software foundation)?(?: either)?(?: version| v)? {version(v)}(?: or (?:any |at your option any )?later(?: version)?)?", 2, 0.95)
            add(full, f"{short}(?: version| v| license)? {version(v)}(?: or later| only)?", 3, 0.8)
        if not versions:
            add(label, f"spdx license identifier {tag}", 1, 1.0)
        add(label, names, 3, 0.9 if versions else 0.95)
        add(label, short, 3, 0.6)
        if short.endswith("gpl"):  # gplv3
            for v in versions.split("|"):
                add(f"{label}-{v.replace(' ', '.')}", f"{short}v{v.split()[0]}", 3, 0.8)
    for kind in CC_KINDS:
        words = " ".join(CC_WORDS[k] for k in kind.split())
        name = "cc-" + kind.replace(" ", "-")
        for v in CC_VERSIONS:
            full = f"{name}-{v.replace(' ', '.')}"
            add(full, f"spdx license identifier cc {kind} {v}", 1, 1.0)
            add(full, f"creativecommons org licenses {kind} {v}", 1, 1.0)
            add(full, f"cc {kind} {v}(?: license)?", 2, 0.95)
            add(full, f"creative commons {words}(?: license)?(?: version)? {v}(?: international| unported| generic)?(?: license)?", 2, 0.95)
        add(name, f"cc {kind}(?: license)?", 3, 0.8)
        add(name, f"creative commons {words}(?: license)?", 3, 0.85)
    for label, pattern, score in SINGLE:
        add(label, pattern, 4 if score < 0.5 else 3, score)
    return out


LEVELS = 4


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def words_joined(text: Column) -> Column:
    """Words between single spaces, one at either end; only separators: two spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, SEPARATORS, " ")), F.lit(" "))


#: Characters that part words, and so stand in no text of words: before and after a match.
BEFORE, AFTER = "\x01", "\x02"
SPAN = "struct<start:int,stop:int>"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def places(joined: Column, pattern: Column) -> Column:
    """Array of (start, stop) in words, from 0, stop after the last, of all matches of a pattern.

    Each match gets a mark before and after it, which end up on the word before it and
    on its last word; their places among the words are its bounds.
    """
    marked = F.regexp_replace(joined, pattern, F.lit(f"{BEFORE}$0{AFTER}"))

    def spans(words: Column) -> Column:
        at = lambda mark: F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)), lambda i: i.isNotNull())
        return F.zip_with(at(BEFORE), at(AFTER), lambda start, stop: F.struct(start.alias("start"), stop.alias("stop")))

    return let(marked, lambda m: F.when(F.contains(m, F.lit(BEFORE)), let(F.split(m, " "), spans)).otherwise(F.array().cast(f"array<{SPAN}>")))


#: Detections that are held against each other at a time.
BLOCK = 512


def suppressed(found: Column) -> Column:
    """Of detections in order, those that no earlier one of as good a priority holds.

    What is dropped lies within what dropped it, so the farthest end of all earlier
    ones of each priority decides: in blocks, each with the ends that the blocks
    before it reach.
    """
    none = F.array(*[F.lit(0)] * LEVELS)

    def reach(ends: Column, x: Column) -> Column:
        return F.transform(ends, lambda e, i: F.when(i + 1 >= x["priority"], F.greatest(e, -x["minus"])).otherwise(e))

    def kept(before: Column, part: Column) -> Column:
        zero = F.struct(before.alias("ends"), F.array().cast("array<boolean>").alias("out"))
        step = lambda s, x: F.struct(reach(s["ends"], x).alias("ends"), F.concat(s["out"], F.array(F.element_at(s["ends"], x["priority"]) < -x["minus"])).alias("out"))
        flags = F.aggregate(part, zero, step, lambda s: s["out"])
        return let(flags, lambda ok: F.filter(F.transform(part, lambda x, i: F.when(ok[i], x)), lambda x: x.isNotNull()))

    def by_block(parts: Column) -> Column:
        most = F.transform(parts, lambda p: F.aggregate(p, none, reach))
        top = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y))
        before = F.aggregate(most, F.array(none), lambda all_, m: F.concat(all_, F.array(top(F.element_at(all_, -1), m))))
        return let(before, lambda ends: F.flatten(F.transform(parts, lambda p, i: kept(ends[i], p))))

    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    return F.when(F.size(found) > 0, let(F.transform(blocks, lambda b: F.slice(found, b * BLOCK + 1, F.lit(BLOCK))), by_block))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    detections: array of (start, stop, label, priority, score), in words, that are
    left after suppression. Null, empty and wordless texts: 0 words, no detections,
    empty strings, null places, score 0. Every row stays, repeated ones too;
    columns of these names are replaced. Labels in code-point order.
    """
    by_keyword: dict[str, list[dict]] = {}
    for r in rules():
        by_keyword.setdefault(r["keyword"], []).append(r)
    table = F.from_json(F.lit(json.dumps(by_keyword)), "map<string,array<struct<label:string,pattern:string,priority:int,score:double>>>")
    keywords = F.array(*map(F.lit, sorted(by_keyword)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    rest = docs.drop(*new)
    loose, words, base_, same, keys, found_, n_words_, kept_ = common.fresh(rest, "_loose", "_words", "_base", "_same", "_keys", "_found", "_n_words", "_kept")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # lower() also turns a few other letters into a-z; it only opens the gate, and the words are made from A-Z alone
    d = rest.withColumn(loose, words_joined(F.lower(text)))
    gate = F.lit(False)
    for g in GATE:
        gate = gate | F.contains(loose, F.lit(g))
    d = d.withColumn(n_words_, F.when(F.col(loose) == "  ", 0).otherwise(spaces(F.col(loose)) - 1).cast("long"))
    d = d.withColumn(words, F.when(gate, words_joined(F.translate(text, upper, upper.lower())))).drop(loose)
    w = F.col(words)

    def stands(phrase: str) -> Column:
        return F.transform(places(w, F.lit(f" {phrase}(?= )")), lambda x: F.struct(x["start"].alias("start"), F.lit(BASE[phrase]).alias("label")))

    hits = F.flatten(F.array(*map(stands, BASE)))
    d = d.withColumn(base_, F.when(w.isNotNull(), hits))
    d = d.withColumn(same, F.when(w.isNotNull(), F.replace(w, F.lit("licence"), F.lit("license"))))  # as many words
    present = F.filter(keywords, lambda k: F.contains(same, k))
    d = d.withColumn(keys, F.when(w.isNotNull(), present))
    # keys are the argument and not in the lambda, where they would be worked out for each rule
    tried = F.flatten(F.transform(keys, lambda k: F.element_at(table, k)))
    found = F.flatten(
        F.transform(tried, lambda r: F.transform(places(F.col(same), r["pattern"]), lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("minus"), r["priority"].alias("priority"), r["label"].alias("label"), r["score"].alias("score"))))
    )
    d = d.withColumn(found_, F.when(w.isNotNull(), F.array_sort(found)))
    d = d.withColumn(kept_, suppressed(F.col(found_)))  # of equal ones the first holds the others
    none = F.array().cast("array<struct<start:int,stop:int,label:string,priority:int,score:double>>")
    own = F.transform(kept_, lambda x: F.struct(x["start"].alias("start"), (-x["minus"]).alias("stop"), x["label"].alias("label"), x["priority"].alias("priority"), x["score"].alias("score")))
    starts, base = F.transform(base_, lambda x: x["start"]), F.coalesce(F.transform(base_, lambda x: x["label"]), F.array().cast("array<string>"))
    labels = F.coalesce(F.transform(kept_, lambda x: x["label"]), F.array().cast("array<string>"))
    return d.select(
        *rest.columns,
        F.col(n_words_).alias("n_words"),
        F.coalesce(F.size(base_), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, labels))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(kept_, lambda x: x["score"])), F.lit(0.0))).alias("score"),
        F.coalesce(own, none).alias("detections"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = "doc_id n_words n_base first_word last_word base_labels labels score".split()
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select(*cols)
