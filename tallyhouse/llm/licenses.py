"""License detection by ordered signature rules.

Texts become words separated by single spaces.  Each rule is a regular expression over
such text with a keyword; it runs only on documents that hold the keyword.  Detections
are intervals of words; one that lies inside another of the same or a better rank is
suppressed.  Everything is DataFrame functions.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.llm.tables import ascii_lower

#: Ranks, best first: a machine-readable tag, a grant, a full name, a short name.
TAG, GRANT, NAME, SHORT = 1, 2, 3, 4
CONFIDENCE = {TAG: 1.0, GRANT: 0.95, NAME: 0.8, SHORT: 0.6}

#: Licenses: label, identifiers in tags, full names, short names, each a regular expression
#: over lower-case words.  Versions are words of their own, as punctuation ends a word.
LICENSES = (
    ("mit", ("mit",), ("mit license", "expat license"), ("mit licensed",)),
    ("mit-0", ("mit 0",), ("mit no attribution(?: license)?",), ("mit 0 license",)),
    ("apache-1.1", ("apache 1 1",), ("apache (?:software )?license (?:version |v )?1 1",), ("apache 1 1",)),
    ("apache-2", ("apache 2 0",), ("apache (?:software )?license (?:version )?v?2(?: 0)?",), ("apache v?2(?: 0)?", "asl v?2(?: 0)?")),
    ("bsd-0-clause", ("0bsd",), ("zero clause bsd(?: license)?", "bsd zero clause license"), ("0 clause bsd",)),
    ("bsd-2-clause", ("bsd 2 clause",), ("(?:simplified|freebsd) (?:bsd )?license",), ("(?:2|two) clause bsd(?: license)?", "bsd 2 clause")),
    ("bsd-3-clause", ("bsd 3 clause",), ("(?:new|revised|modified) bsd license",), ("(?:3|three) clause bsd(?: license)?", "bsd 3 clause")),
    ("bsd-4-clause", ("bsd 4 clause",), ("original bsd license",), ("(?:4|four) clause bsd(?: license)?", "bsd 4 clause")),
    ("isc", ("isc",), ("isc license", "internet systems consortium license"), ("isc licensed",)),
    ("zlib", ("zlib",), ("zlib(?: libpng)? license",), ("zlib licensed",)),
    ("bsl-1", ("bsl 1 0",), ("boost software license(?: version)?(?: 1 0)?",), ("boost license",)),
    ("unlicense", ("unlicense",), ("the unlicense",), ("unlicensed into the public domain",)),
    ("wtfpl", ("wtfpl",), ("do what the \\w+ you want to public license",), ("wtfpl(?: license)?",)),
    ("mpl-1.1", ("mpl 1 1",), ("mozilla public license (?:version |v )?1 1",), ("mpl v?1 1",)),
    ("mpl-2", ("mpl 2 0",), ("mozilla public license (?:version )?v?2(?: 0)?",), ("mpl v?2(?: 0)?",)),
    ("epl-1", ("epl 1 0",), ("eclipse public license (?:version )?v?1(?: 0)?",), ("epl v?1(?: 0)?",)),
    ("epl-2", ("epl 2 0",), ("eclipse public license (?:version )?v?2(?: 0)?",), ("epl v?2(?: 0)?",)),
    ("cddl-1", ("cddl 1 0",), ("common development and distribution license(?: version)?(?: 1(?: 0)?)?",), ("cddl(?: v?1(?: 0)?)?",)),
    ("cpl-1", ("cpl 1 0",), ("common public license(?: version)?(?: 1(?: 0)?)?",), ("cpl v?1(?: 0)?",)),
    ("eupl-1.2", ("eupl 1 2",), ("european union public licen[cs]e(?: version| v)?(?: 1 2)?",), ("eupl(?: v?1 2)?",)),
    ("artistic-1", ("artistic 1 0",), ("artistic license(?: version)?(?: 1 0)?(?! 2)",), ("artistic 1 0",)),
    ("artistic-2", ("artistic 2 0",), ("artistic license (?:version )?v?2(?: 0)?",), ("artistic 2 0",)),
    ("gpl-1", ("gpl 1 0(?: only| or later)?",), ("gnu general public license (?:version )?v?1(?: 0)?",), ("gplv1", "gpl v?1(?: 0)?")),
    ("gpl-2", ("gpl 2 0(?: only| or later)?",), ("gnu general public license (?:version )?v?2(?: 0)?(?: or later)?",), ("gplv2", "gpl v?2(?: 0)?")),
    ("gpl-3", ("gpl 3 0(?: only| or later)?",), ("gnu general public license (?:version )?v?3(?: 0)?(?: or later)?",), ("gplv3", "gpl v?3(?: 0)?")),
    ("gpl", ("gpl",), ("gnu general public license", "gnu gpl"), ("gpl licensed", "gpl license")),
    ("lgpl-2", ("lgpl 2 0(?: only| or later)?",), ("gnu library general public license (?:version )?v?2(?: 0)?",), ("lgplv2", "lgpl v?2(?: 0)?")),
    ("lgpl-2.1", ("lgpl 2 1(?: only| or later)?",), ("gnu lesser general public license (?:version )?v?2 1",), ("lgplv2 1", "lgpl v?2 1")),
    ("lgpl-3", ("lgpl 3 0(?: only| or later)?",), ("gnu lesser general public license (?:version )?v?3(?: 0)?",), ("lgplv3", "lgpl v?3(?: 0)?")),
    ("lgpl", ("lgpl",), ("gnu (?:lesser|library) general public license", "gnu lgpl"), ("lgpl licensed", "lgpl license")),
    ("agpl-3", ("agpl 3 0(?: only| or later)?",), ("gnu affero general public license (?:version )?v?3(?: 0)?",), ("agplv3", "agpl v?3(?: 0)?")),
    ("agpl", ("agpl",), ("(?:gnu )?affero general public license", "gnu agpl"), ("agpl licensed", "agpl license")),
    ("gfdl-1.3", ("gfdl 1 3(?: only| or later)?",), ("gnu free documentation license (?:version )?v?1 3",), ("gfdl v?1 3",)),
    ("gfdl", ("gfdl",), ("gnu free documentation license",), ("gnu fdl",)),
    ("cc0", ("cc0 1 0",), ("creative commons (?:cc0|zero)(?: license)?(?: 1 0)?(?: universal)?",), ("cc0(?: 1 0)?", "cc zero")),
    ("cc-by", ("cc by(?: [1-4] [05])?(?! n| s)",), ("creative commons attribution(?: [1-4] [05])?(?: international)?(?: license)?(?! non| share| no)",), ("cc by(?: [1-4] [05])?(?! n| s)",)),
    ("cc-by-sa", ("cc by sa(?: [1-4] [05])?",), ("creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?",), ("cc by sa(?: [1-4] [05])?",)),
    ("cc-by-nd", ("cc by nd(?: [1-4] [05])?",), ("creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?",), ("cc by nd(?: [1-4] [05])?",)),
    ("cc-by-nc", ("cc by nc(?: [1-4] [05])?(?! s| n)",), ("creative commons attribution non ?commercial(?: [1-4] [05])?(?! share| no)",), ("cc by nc(?: [1-4] [05])?(?! s| n)",)),
    ("cc-by-nc-sa", ("cc by nc sa(?: [1-4] [05])?",), ("creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?",), ("cc by nc sa(?: [1-4] [05])?",)),
    ("cc-by-nc-nd", ("cc by nc nd(?: [1-4] [05])?",), ("creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?",), ("cc by nc nd(?: [1-4] [05])?",)),
    ("odbl", ("odbl 1 0",), ("open (?:data commons open )?database license(?: v?1 0)?",), ("odbl(?: v?1 0)?",)),
    ("odc-by", ("odc by 1 0",), ("open data commons attribution license",), ("odc by",)),
    ("pddl", ("pddl 1 0",), ("public domain dedication and license",), ("pddl",)),
    ("ofl-1.1", ("ofl 1 1",), ("sil open font license(?: version)?(?: 1 1)?",), ("ofl v?1 1",)),
    ("psf-2", ("psf 2 0", "python 2 0"), ("python software foundation license(?: version)?(?: 2)?",), ("psf license",)),
    ("php-3", ("php 3 01?",), ("php license (?:version )?v?3(?: 0?1?)?",), ("php license",)),
    ("ms-pl", ("ms pl",), ("microsoft public license",), ("ms pl",)),
    ("ms-rl", ("ms rl",), ("microsoft reciprocal license",), ("ms rl",)),
    ("osl-3", ("osl 3 0",), ("open software license (?:version )?v?3(?: 0)?",), ("osl v?3(?: 0)?",)),
    ("afl-3", ("afl 3 0",), ("academic free license (?:version )?v?3(?: 0)?",), ("afl v?3(?: 0)?",)),
    ("ncsa", ("ncsa",), ("university of illinois ncsa open source license",), ("ncsa license",)),
    ("bsl-business", ("busl 1 1",), ("business source license(?: 1 1)?",), ("busl 1 1",)),
    ("sspl-1", ("sspl 1 0",), ("server side public license(?: version)?(?: 1)?",), ("sspl(?: v?1)?",)),
    ("elastic-2", ("elastic 2 0",), ("elastic license (?:version )?v?2(?: 0)?",), ("elastic license",)),
    ("openrail", ("openrail",), ("(?:creativeml |bigscience )?open rail m? ?license",), ("openrail m?",)),
)

#: Signatures of license texts and notices: label, rank, keyword, regular expression.
NOTICES = (
    ("mit", GRANT, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", GRANT, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd-3-clause", GRANT, "redistribution", "neither the name of .{1,200}? may be used to endorse or promote products"),
    ("bsd-2-clause", GRANT, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", GRANT, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", GRANT, "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("unlicense", GRANT, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", GRANT, "warranty", "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("wtfpl", GRANT, "just", "you just do what the \\w+ you want to"),
    ("public-domain", NAME, "public domain", "(?:dedicated to|released into|placed in|in) the public domain"),
    ("proprietary", NAME, "proprietary", "proprietary and confidential"),
    ("all-rights-reserved", SHORT, "rights reserved", "all rights reserved"),
    ("mit", TAG, "opensource org", "opensource org licenses mit"),
    ("apache-2", TAG, "apache org", "apache org licenses license 2 0"),
    ("cc-by-nc", TAG, "creativecommons org", "creativecommons org licenses by nc(?! sa| nd)"),
    ("cc-by", TAG, "creativecommons org", "creativecommons org licenses by(?! n| s)"),
    ("cc-by-sa", TAG, "creativecommons org", "creativecommons org licenses by sa"),
    ("cc0", TAG, "creativecommons org", "creativecommons org publicdomain zero"),
    ("gpl-3", TAG, "gnu org", "gnu org licenses gpl 3 0"),
    ("mpl-2", TAG, "mozilla org", "mozilla org mpl 2 0"),
)

#: Fixed phrases, with the label each gives wherever its words stand in a row.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: One of these stands in every document with a phrase or a detection, some as a whole word only.
GATE_PARTS = (
    "licen", "apache", "mozilla", "creative", "spdx", "permission", "redistribut", "public", "proprietary",
    "reserved", "unencumbered", "warranty", "opensource", "openrail", "wtfpl", "artistic", "gplv",
)
GATE_WORDS = (
    "cc", "cc0", "gpl", "lgpl", "agpl", "gnu", "bsd", "0bsd", "mpl", "epl", "cddl", "cpl", "eupl", "gfdl", "odbl", "odc", "pddl",
    "ofl", "ms", "osl", "afl", "asl", "sspl", "busl", "lgplv2", "just",
)


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    rank: int
    keyword: str
    pattern: str
    also: str


def _keyword(pattern: str) -> str:
    """The longest literal that every match of the pattern holds; patterns start or end with one."""
    import re

    plain, depth = "", 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        optional = i + 1 < len(pattern) and pattern[i + 1] == "?"
        plain += c if depth == 0 and (c.isalnum() or c == " ") and not optional and not (i and pattern[i - 1] == "\\") else "\x00"
    parts = [p.strip() for p in re.split("\x00+", plain)]
    return max(parts, key=len)


def _spaced(pattern: str) -> str:
    """The keyword of a pattern that matches whole words, with the spaces around it where it ends the pattern."""
    word = _keyword(pattern)
    return " " * pattern.startswith(word) + word + " " * (pattern == word)


def rules() -> list[Rule]:
    """All rules in order: for each license its tags, grants, full names and short names, then the notices."""
    made = []

    def add(label: str, rank: int, pattern: str, keyword: str | None = None, also: str | None = None) -> None:
        keyword = keyword or _keyword(pattern)
        made.append(Rule(len(made), label, rank, keyword, f"(?<= ){pattern}(?= )", also or keyword))

    for label, tags, names, shorts in LICENSES:
        for tag in tags:
            add(label, TAG, f"spdx license identifier {tag}", "spdx license identifier")
            add(label, TAG, f"license {tag}(?= )(?! license)", "license " + _keyword(tag).split(" ")[0])
        for name in (*names, *shorts, *tags):
            add(label, GRANT, f"(?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: license)?", "under", _spaced(name))
        for name in names:
            add(label, NAME, name)
        for short in shorts:
            add(label, SHORT, short)
    for label, rank, keyword, pattern in NOTICES:
        add(label, rank, pattern, keyword)
    return made


def _rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(r.number, r.label, r.rank, r.keyword, r.pattern, r.also) for r in rules()],
        "rule int, label string, rank int, keyword string, pattern string, also string",
    )


def normal(text: Column) -> Column:
    """Lower-case words with one space before, between and after them."""
    return F.concat(F.lit(" "), F.call_function("btrim", F.regexp_replace(ascii_lower(text), WORD_GAP, " ")), F.lit(" "))


def gated(text: str) -> Column:
    """Whether the text may hold a phrase or a detection.

    Substrings first, as they are looked for byte by byte; a short keyword must also
    stand between other characters than letters and digits.  lower() changes more than
    A to Z, but never one of these into something else.
    """

    def any_of(low: Column) -> Column:
        found = F.lit(False)
        for part in GATE_PARTS:
            found = found | F.contains(low, F.lit(part))
        for word in GATE_WORDS:
            gap = f"(?<![0-9a-z\\x{{80}}-\\x{{10FFFF}}]){word}(?![0-9a-z\\x{{80}}-\\x{{10FFFF}}])"
            found = found | (F.contains(low, F.lit(word)) & F.rlike(low, F.lit(gap)))
        return found

    # a one-element array so that the text is lower-cased once
    return F.coalesce(F.transform(F.array(F.lower(text)), any_of)[0], F.lit(False))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detections(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """One row per detection that stands: the columns `by`, text_hash, label, rank, start, end (words, from 0), matched.

    A detection is suppressed if another one covers it and has the same or a better
    rank; of two on the same words the better rank, then the earlier rule stands.
    Rows equal in `by` and text give their detections once.  A null text has none.
    """
    source = docs.where(gated(text)).select(*by, F.xxhash64(text).alias("text_hash"), normal(F.col(text)).alias("norm"))
    source = source.dropDuplicates([*by, "text_hash"])
    words = sorted({r.keyword for r in rules()})
    found = F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(F.col("norm"), k))
    # a fixed table of a few hundred rows
    pairs = source.withColumn("keyword", F.explode(found)).join(F.broadcast(_rules_table(docs.sparkSession)), "keyword")
    hits = (
        pairs.where("contains(norm, also) AND regexp(norm, pattern)")
        .selectExpr(*by, "text_hash", "rule", "label", "rank", "regexp_extract_all(norm, pattern, 0) AS found", "split(norm, pattern) AS gaps")
        .selectExpr(*by, "text_hash", "rule", "label", "rank", "posexplode(arrays_zip(gaps, found)) AS (place, piece)")
    )
    doc = [*by, "text_hash"]
    before = Window.partitionBy(*doc, "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap, match = F.col("piece.gaps"), F.col("piece.found")
    seen = F.sum(_spaces(gap) + F.coalesce(_spaces(match), F.lit(0))).over(before) - F.coalesce(_spaces(match), F.lit(0)) - 1
    placed = hits.select(*doc, "rule", "label", "rank", seen.alias("start"), match.alias("matched")).where("matched IS NOT NULL")
    placed = placed.withColumn("end", F.col("start") + _spaces(F.col("matched")))
    earlier = (
        Window.partitionBy(*doc)
        .orderBy("start", F.desc("end"), "rank", "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = {f"reach{q}": F.max(F.when(F.col("rank") == q, F.col("end"))).over(earlier) for q in CONFIDENCE}
    covered = F.lit(False)
    for q in CONFIDENCE:
        covered = covered | ((F.lit(q) <= F.col("rank")) & F.coalesce(F.col(f"reach{q}") >= F.col("end"), F.lit(False)))
    return placed.withColumns(reach).where(~covered).select(*doc, "label", "rank", "start", "end", "matched")


def _first(norm: Column, phrase: str) -> Column:
    """Words before the first place of the phrase; null if there is none."""
    at = F.instr(norm, F.lit(f" {phrase} "))
    return F.when(at > 0, _spaces(F.substring(norm, F.lit(1), at)) - 1)


def phrase_counts(norm: Column, n_words: Column) -> tuple[Column, Column, Column, Column]:
    """(places, first start, last start, labels) of the fixed phrases."""
    places, first, last, labels = F.lit(0), [], [], []
    for phrase, label in PHRASES:
        n = F.regexp_count(norm, F.lit(f"(?<= ){phrase}(?= )"))
        places = places + n
        first.append(_first(norm, phrase))
        last.append(n_words - _first(F.reverse(norm), phrase[::-1]) - len(phrase.split()))
        labels.append(F.when(n > 0, F.lit(label)))
    return places, F.least(*first), F.greatest(*last), F.array_compact(F.array(*labels))


def scan_licenses(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Per row of `docs`: `by`, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score.

    Base labels come from the fixed phrases, the others from the rules.  The score is
    the confidence of the best rank found, 0 if there is none.  A null or empty text
    has no words and no labels; repeated rows are answered one by one; nulls in `by`
    match each other; an empty table gives an empty result.
    """
    best = F.lit(0.0)
    for rank, sure in CONFIDENCE.items():
        best = F.greatest(best, F.when(F.col("rank") == rank, F.lit(sure)).otherwise(F.lit(0.0)))
    found = (
        detections(docs, by, text)
        .groupBy(*by, "text_hash")
        .agg(F.collect_set("label").alias("more"), F.max(best).alias("sure"))
        .withColumnsRenamed({c: f"{c}_found" for c in (*by, "text_hash")})
    )
    rows = docs.select(*by, F.xxhash64(text).alias("text_hash"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.when(gated(text), normal(F.col(text))).alias("norm"))
    places, first, last, labels = phrase_counts(F.col("norm"), F.col("n_words"))
    rows = rows.select(*by, "text_hash", "n_words", F.coalesce(places, F.lit(0)).cast("long").alias("n_base"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), F.coalesce(labels, F.array().cast("array<string>")).alias("base_labels"))
    same = rows["text_hash"] == found["text_hash_found"]
    for c in by:
        same = same & rows[c].eqNullSafe(found[f"{c}_found"])
    return rows.join(found, same, "left").select(
        *[rows[c] for c in by],
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_sort("base_labels").alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>"))))).alias("labels"),
        F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(CONFIDENCE[GRANT])).otherwise(F.lit(0.0))).alias("score"),
    )
