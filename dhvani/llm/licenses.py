"""License scan by ordered signature rules, in native expressions only.

A text becomes its word string: A-Z lower-cased, every other ASCII character but a
digit a space, runs of spaces one.  Rules are regular expressions over that string,
each with a keyword, a label and a priority (3: an identifier tag or a full licence
name in a grant; 2: a name with its version; 1: a bare name or a hint).  A rule runs
only on texts that hold its keyword.  Every match is an interval; an interval inside
another of the same or a higher priority is suppressed, as is an equal one of a rule
that stands later.  What is left, with the base phrases, makes the labels.

Everything is done per row by built-in functions: no shuffle, no Python.  Texts
without a keyword cost the word count and one look for the keywords.

Cases: null or empty text: no words, no labels, score 0; a null doc_id and repeated
rows keep their rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kit

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label, keyword that every form of the name holds, the name as a pattern over words.
FAMILIES = [
    ("gpl-1.0", "gnu", r"gnu general public licen[sc]e (?:as published .{0,60}?)?(?:version|v) ?1(?: 0)?"),
    ("gpl-2.0", "gnu", r"gnu general public licen[sc]e (?:as published .{0,60}?)?(?:version|v) ?2(?: 0)?"),
    ("gpl-3.0", "gnu", r"gnu general public licen[sc]e (?:as published .{0,60}?)?(?:version|v) ?3(?: 0)?"),
    ("gpl", "gpl", r"(?:gnu )?gplv?(?: ?[123](?: 0)?)?"),
    ("gpl", "gnu general", r"gnu general public licen[sc]e"),
    ("lgpl-2.0", "lesser", r"gnu (?:lesser|library) general public licen[sc]e (?:version|v) ?2(?: 0)?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[sc]e (?:version|v) ?2 1"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public licen[sc]e (?:version|v) ?3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgplv?(?: ?[23](?: [01])?)?"),
    ("lgpl", "lesser general", r"gnu lesser general public licen[sc]e"),
    ("agpl-3.0", "affero", r"gnu affero general public licen[sc]e(?: (?:version|v) ?3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"agplv?(?: ?3(?: 0)?)?"),
    ("gfdl", "documentation", r"gnu free documentation licen[sc]e(?: version 1 [0-3])?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e (?:version |v)?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e (?:version |v)?2(?: 0)?"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("mit", "mit licen", r"(?:the )?mit licen[sc]e"),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "expat", r"expat licen[sc]e"),
    ("mit-0", "no attribution", r"mit no attribution"),
    ("x11", "x11", r"(?:mit )?x11 licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified|free) bsd licen[sc]e|bsd 2 clause(?: licen[sc]e)?|2 clause bsd(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised) bsd licen[sc]e|bsd 3 clause(?: licen[sc]e)?|3 clause bsd(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"original bsd licen[sc]e|bsd 4 clause(?: licen[sc]e)?|4 clause bsd(?: licen[sc]e)?"),
    ("bsd-0-clause", "bsd", r"zero clause bsd(?: licen[sc]e)?|0bsd"),
    ("bsd", "bsd licen", r"bsd licen[sc]e"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification"),
    ("isc", "isc licen", r"isc licen[sc]e"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e (?:version |v)?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e (?:version |v)?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e (?:version |v)?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e(?: version 1(?: 0)?)?"),
    ("cpl-1.0", "common public", r"common public licen[sc]e(?: version 1(?: 0)?)?"),
    ("eupl-1.2", "european union", r"european union public licen[sc]e(?: (?:version |v )?1 [012])?"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e (?:version )?2(?: 0)?"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("boost-1.0", "boost", r"boost software licen[sc]e(?: version 1(?: 0)?)?"),
    ("psf-2.0", "python software", r"python software foundation licen[sc]e(?: version 2)?"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("php-3.01", "php licen", r"php licen[sc]e(?: version 3 01)?"),
    ("ruby", "ruby licen", r"ruby licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "by nc nd", r"(?:cc|creative commons) by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "by nc sa", r"(?:cc|creative commons) by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "by nc", r"(?:cc|creative commons) by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "by nd", r"(?:cc|creative commons) by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "by sa", r"(?:cc|creative commons) by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by", "creative commons attribution", r"creative commons attribution(?: [1-4] [05])?(?: international)?"),
    ("cc-by-sa", "share", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "commercial", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc", "creative commons", r"creative commons(?: licen[sc]e)?"),
    ("odbl-1.0", "open database", r"open database licen[sc]e"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[sc]e"),
    ("ogl-3.0", "open government", r"open government licen[sc]e(?: v3 0)?"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: (?:version )?1 1)?"),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain"),
    ("rail", "openrail", r"openrail(?: ?m)?"),
    ("llama", "community licen", r"llama [23] community licen[sc]e(?: agreement)?"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e(?: (?:version |v)?1)?"),
    ("busl-1.1", "business source", r"business source licen[sc]e(?: 1 1)?"),
    ("elastic-2.0", "elastic licen", r"elastic licen[sc]e(?: 2 0)?"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
]
# The forms a name stands in; priority, words before and after it.
FORMS = [
    (3, r"(?:licen[sc]ed|released|distributed|available|published|provided|made available) under (?:the )?(?:terms of )?(?:the |an |a )?", r""),
    (3, r"spdx licen[sc]e identifier ", r""),
    (2, r"(?:this|the) (?:work|software|program|file|code|text|document|data ?set) is (?:under|covered by|subject to) (?:the )?", r""),
    (1, r"", r""),
]


#: Entries of a part of a growing list.
PART = 128


def rules() -> list[tuple[str, str, int, str]]:
    """(label, keyword, priority, pattern) in order: each family in each form.  A
    pattern is bounded by the spaces of the word string; the last isn't consumed."""
    return [(label, key, level, f" {before}(?:{name}){after}(?= )") for level, before, after in FORMS
            for label, key, name in FAMILIES]


def words(text) -> Column:
    """The word string: " w1 w2 ... "; one space for a text without words."""
    # The ASCII characters that aren't letters or digits.
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" ")))


def _grown(done: Column, part: Column, one: Column) -> tuple[Column, Column]:
    """A list that grows at its end, as full parts and an open one: an array is copied for
    each entry that is added, so one long array would cost the square of its length."""
    full = F.size(part) >= PART
    return (F.when(full, F.concat(done, F.array(part))).otherwise(done),
            F.when(full, F.array(one)).otherwise(F.concat(part, F.array(one))))


def _whole(state: Column) -> Column:
    return F.flatten(F.concat(state["done"], F.array(state["part"])))


def _none(kind: str) -> list[Column]:
    return [F.array().cast(f"array<array<{kind}>>").alias("done"), F.array().cast(f"array<{kind}>").alias("part")]


def _hits(s: Column, pattern: Column) -> Column:
    """(a, b) of all matches: the pieces between them and their lengths, added up."""
    gap = F.transform(F.split(s, pattern, -1), F.length)
    hit = F.transform(F.regexp_extract_all(s, pattern, F.lit(0)), F.length)
    start = F.struct(F.lit(0).alias("at"), *_none("struct<a:int,b:int>"))

    def add(state, pair):
        a = state["at"] + pair["gap"]
        b = a + pair["hit"]
        done, part = _grown(state["done"], state["part"], F.struct(a.alias("a"), b.alias("b")))
        return F.struct(b.alias("at"), done.alias("done"), part.alias("part"))
    # The last piece has no match after it.
    pairs = F.zip_with(F.slice(gap, 1, F.size(hit)), hit, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, start, add, _whole)


def detections(s: Column) -> Column:
    """Kept (label, level, a, b) of a word string, by place."""
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(key).alias("key"), F.lit(level).alias("level"),
                               F.lit(pattern).alias("pattern"), F.lit(i).alias("rule"))
                      for i, (label, key, level, pattern) in enumerate(rules())])
    due = F.filter(table, lambda r: F.contains(s, r["key"]))
    found = F.flatten(F.transform(due, lambda r: F.transform(
        _hits(s, r["pattern"]), lambda h: F.struct(h["a"].alias("a"), (-h["b"]).alias("z"), (-r["level"]).alias("rank"),
                                                   r["rule"].alias("rule"), r["label"].alias("label")))))
    # By start, longer first, then priority and order of the rules: whatever contains
    # an interval stands before it, so the furthest end so far, kept for each priority,
    # tells whether one of the same or a higher priority does.
    state = F.struct(F.lit(-1).alias("e1"), F.lit(-1).alias("e2"), F.lit(-1).alias("e3"),
                     *_none("struct<label:string,level:int,a:int,b:int>"))

    def step(st, h):
        level, end = -h["rank"], -h["z"]
        reach = F.when(level == 1, st["e1"]).when(level == 2, st["e2"]).otherwise(st["e3"])
        e = {f"e{k}": F.when((level >= k) & (end > st[f"e{k}"]), end).otherwise(st[f"e{k}"]) for k in (1, 2, 3)}
        one = F.struct(h["label"].alias("label"), level.alias("level"), h["a"].alias("a"), end.alias("b"))
        done, part = _grown(st["done"], st["part"], one)
        done, part = (F.when(end <= reach, st[k]).otherwise(v).alias(k) for k, v in (("done", done), ("part", part)))
        return F.struct(*[v.alias(k) for k, v in e.items()], done, part)
    return F.aggregate(F.sort_array(found), state, step, _whole)


# Every name above and every base phrase holds one of these.
GATE = ("licen", "gpl", "permission", "redistribution", "bsd", "attribution", "wtfpl", "cc", "creative", "domain",
        "openrail", "reserved", "confidential")


def keyword_gate(text: Column) -> Column:
    """Whether the text holds one of the words without which no rule can match."""
    low = F.lower(text)
    gate = F.contains(low, F.lit(GATE[0]))
    for word in GATE[1:]:
        gate = gate | F.contains(low, F.lit(word))
    return F.coalesce(gate, F.lit(False))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (of the best rule kept: 0.5, 0.75 or 1 by priority; 0 for none) and
    ``detections``: label, level, a, b (places in the word string)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    d = d.select("doc_id", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"),
                 F.when(keyword_gate(F.col("text")), words(F.col("text"))).otherwise(F.lit(" ")).alias("s"))
    places = {p: (F.regexp_count("s", F.lit(f" {p}(?= )")).cast("long"),
                  F.locate(f" {p} ", F.col("s")), F.locate(f" {p[::-1]} ", F.reverse("s"))) for p in BASE}
    first = [F.when(at > 0, _spaces(F.left("s", at - 1))) for _, at, _ in places.values()]
    last = [F.when(at > 0, F.col("n_words") - _spaces(F.left(F.reverse("s"), at - 1)) - len(p.split()))
            for p, (_, _, at) in places.items()]
    base = F.array_compact(F.array(*[F.when(F.contains("s", F.lit(f" {p} ")), F.lit(l)) for p, l in BASE.items()]))
    held = F.col("s") != " "
    none = F.array().cast("array<struct<label:string,level:int,a:int,b:int>>")
    d = d.select("doc_id", "n_words", sum((n for n, _, _ in places.values()), F.lit(0).cast("long")).alias("n_base"),
                 F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
                 F.array_sort(base).alias("base"), F.when(held, detections(F.col("s"))).otherwise(none).alias("detections"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda h: h["label"]))))
    level = F.coalesce(F.array_max(F.transform("detections", lambda h: h["level"])), F.lit(0))
    score = F.when(level == 0, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).otherwise(0.25 + 0.25 * level)
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                    F.array_join(labels, ",").alias("labels"), score.cast("double").alias("score"), "detections")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return scan(kit.table(spark, sf_dir, "documents")).drop("detections")
