"""Licence detection by ordered signature rules, in DataFrame functions only.

Texts are reduced to their lower-cased words, one space between two, and every rule is a
regular expression over such words.  Rules come from families (a name as it is written in
prose, and its version) and the forms a name is met in: an SPDX tag, a grant, a link, a
name with version, a bare name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything that stands between words.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: A word in a text whose capitals are still there.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BEGIN, END = "\x01", "\x02"
#: Detections that are compared one by one; of those before, only the greatest end counts.
BLOCK = 64

# fixed values: the phrases whose places are counted, and their labels
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


class Family(NamedTuple):
    label: str
    keyword: str  # a text without it has no match
    name: str
    version: str = ""
    spdx: str = ""
    link: str = ""


def _v(number: str) -> str:
    """A version of words: ``2 0`` also as ``2``, with or without a word before it."""
    major, _, minor = number.partition(" ")
    return f"(?:version |v |ver )?v?{major}" + (f"(?: {minor})" + "?" * (minor == "0") if minor else "")


def _gnu(label: str, name: str, short: str, versions: Iterable[str]) -> list[Family]:
    lib = "(?:the )?" + name
    out = [Family(f"{label}-{v.replace(' ', '.')}", k, n, _v(v), f"{short} {v}(?: only| or later)?", f"gnu org licenses (?:old licenses )?{short} {v}")
           for v in versions for k, n in (("gnu", lib), (short, f"(?:gnu )?{short}"))]
    return [*out, Family(label, "gnu", lib), Family(label, short, f"gnu {short}")]


def _cc() -> list[Family]:
    parts = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial",
             "by-nd": "attribution no ?deriv(?:ative)?s", "by-nc-sa": "attribution non ?commercial share ?alike",
             "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
    out = []
    for code, prose in parts.items():
        words = code.replace("-", " ")
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            where = "(?: international| unported| generic)?"
            out.append(Family(f"cc-{code}-{v.replace(' ', '.')}", "cc", f"cc {words}", _v(v) + where, f"cc {words} {v}", f"creativecommons org licenses {words} {v}"))
            out.append(Family(f"cc-{code}-{v.replace(' ', '.')}", "creative commons", f"creative commons {prose}", _v(v) + where))
        out.append(Family(f"cc-{code}", "cc", f"cc {words}"))
        out.append(Family(f"cc-{code}", "creative commons", f"creative commons {prose}"))
    return out


def _plain(rows: str) -> list[Family]:
    """Families of one line each: label | keyword | name | version | SPDX words."""
    return [Family(*(part.strip() for part in re.split(r" \|(?= |$)", row))) for row in rows.strip().splitlines()]


FAMILIES: list[Family] = [
    *_gnu("gpl", "gnu general public licen[sc]e", "gpl", ("1 0", "2 0", "3 0")),
    *_gnu("lgpl", "gnu (?:lesser|library) general public licen[sc]e", "lgpl", ("2 0", "2 1", "3 0")),
    *_gnu("agpl", "gnu affero general public licen[sc]e", "agpl", ("1 0", "3 0")),
    *_gnu("gfdl", "gnu free documentation licen[sc]e", "gfdl", ("1 1", "1 2", "1 3")),
    *_cc(),
    *_plain(r"""
    apache-2.0 | apache | apache (?:software )?licen[sc]e | (?:version |v )?v?2(?: 0)? | apache 2 0
    apache-1.1 | apache | apache (?:software )?licen[sc]e | (?:version |v )?v?1 1 | apache 1 1
    apache-1.0 | apache | apache (?:software )?licen[sc]e | (?:version |v )?v?1 0 | apache 1 0
    apache | apache | apache (?:software )?licen[sc]e
    mit | mit | mit (?:open source )?licen[sc]e | | mit
    mit-0 | no attribution | mit no attribution(?: licen[sc]e)? | | mit 0
    x11 | x11 | x11 licen[sc]e | | x11
    expat | expat | expat licen[sc]e
    bsd-2-clause | bsd | bsd (?:2|two) clause(?: licen[sc]e)? | | bsd 2 clause
    bsd-2-clause | bsd | (?:simplified|freebsd) bsd licen[sc]e
    bsd-3-clause | bsd | bsd (?:3|three) clause(?: licen[sc]e)? | | bsd 3 clause
    bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[sc]e
    bsd-4-clause | bsd | bsd (?:4|four) clause(?: licen[sc]e)? | | bsd 4 clause
    bsd-4-clause | bsd | (?:original|old) bsd licen[sc]e
    0bsd | bsd | (?:zero clause bsd|bsd zero clause)(?: licen[sc]e)? | | 0bsd
    bsd | bsd | bsd(?: style)? licen[sc]e
    isc | isc | isc licen[sc]e | | isc
    mpl-1.1 | mozilla | mozilla public licen[sc]e | (?:version |v )?v?1 1 | mpl 1 1
    mpl-2.0 | mozilla | mozilla public licen[sc]e | (?:version |v )?v?2(?: 0)? | mpl 2 0
    mpl | mozilla | mozilla public licen[sc]e
    epl-1.0 | eclipse | eclipse public licen[sc]e | (?:version |v )?v?1(?: 0)? | epl 1 0
    epl-2.0 | eclipse | eclipse public licen[sc]e | (?:version |v )?v?2(?: 0)? | epl 2 0
    epl | eclipse | eclipse public licen[sc]e
    edl-1.0 | eclipse | eclipse distribution licen[sc]e
    cddl-1.0 | common development | common development and distribution licen[sc]e | (?:version |v )?v?1 0 | cddl 1 0
    cddl-1.1 | common development | common development and distribution licen[sc]e | (?:version |v )?v?1 1 | cddl 1 1
    cddl | common development | common development and distribution licen[sc]e
    cpl-1.0 | common public | common public licen[sc]e | (?:version |v )?v?1(?: 0)? | cpl 1 0
    eupl-1.1 | european union | european union public licen[sc]e | (?:version |v )?v?1 1 | eupl 1 1
    eupl-1.2 | european union | european union public licen[sc]e | (?:version |v )?v?1 2 | eupl 1 2
    eupl | european union | european union public licen[sc]e
    artistic-1.0 | artistic | artistic licen[sc]e | (?:version |v )?v?1(?: 0)? | artistic 1 0
    artistic-2.0 | artistic | artistic licen[sc]e | (?:version |v )?v?2(?: 0)? | artistic 2 0
    artistic | artistic | artistic licen[sc]e
    bsl-1.0 | boost | boost software licen[sc]e | (?:version |v )?v?1(?: 0)? | bsl 1 0
    boost | boost | boost software licen[sc]e
    busl-1.1 | business source | business source licen[sc]e | (?:version |v )?v?1 1 | busl 1 1
    busl | business source | business source licen[sc]e
    sspl-1.0 | server side | server side public licen[sc]e | (?:version |v )?v?1(?: 0)? | sspl 1 0
    elastic-2.0 | elastic | elastic licen[sc]e | (?:version |v )?v?2(?: 0)? | elastic 2 0
    elastic | elastic | elastic licen[sc]e
    unlicense | unlicense | the unlicense | | unlicense
    wtfpl | what the | do what the \S+ you want to public licen[sc]e | | wtfpl
    zlib | zlib | zlib(?: libpng)? licen[sc]e | | zlib
    libpng | libpng | libpng licen[sc]e | | libpng
    openssl | openssl | openssl licen[sc]e | | openssl
    psf-2.0 | python | python software foundation licen[sc]e | (?:version |v )?v?2(?: 0)? | psf 2 0
    psf | python | python software foundation licen[sc]e
    python-2.0 | python | python licen[sc]e | (?:version |v )?v?2(?: 0)? | python 2 0
    php-3.01 | php | php licen[sc]e | (?:version |v )?v?3 01 | php 3 01
    php | php | php licen[sc]e
    ruby | ruby | ruby licen[sc]e | | ruby
    vim | vim | vim licen[sc]e | | vim
    postgresql | postgresql | postgresql licen[sc]e | | postgresql
    ncsa | ncsa | (?:university of illinois )?ncsa open source licen[sc]e | | ncsa
    afl-3.0 | academic | academic free licen[sc]e | (?:version |v )?v?3(?: 0)? | afl 3 0
    afl | academic | academic free licen[sc]e
    osl-3.0 | open software | open software licen[sc]e | (?:version |v )?v?3(?: 0)? | osl 3 0
    osl | open software | open software licen[sc]e
    ofl-1.1 | open font | sil open font licen[sc]e | (?:version |v )?v?1 1 | ofl 1 1
    ofl | open font | (?:sil )?open font licen[sc]e
    odbl-1.0 | open data | open (?:data commons open )?database licen[sc]e | (?:version |v )?v?1 0 | odbl 1 0
    odbl | open data | open (?:data commons open )?database licen[sc]e
    odc-by-1.0 | open data | open data commons attribution licen[sc]e | | odc by 1 0
    pddl-1.0 | open data | open data commons public domain dedication(?: and licen[sc]e)? | | pddl 1 0
    ms-pl | microsoft | microsoft public licen[sc]e | | ms pl
    ms-rl | microsoft | microsoft reciprocal licen[sc]e | | ms rl
    upl-1.0 | universal | universal permissive licen[sc]e | | upl 1 0
    cecill-2.1 | cecill | cecill(?: free software)? licen[sc]e | (?:version |v )?v?2 1 | cecill 2 1
    cecill | cecill | cecill(?: free software)? licen[sc]e
    mulan-2.0 | mulan | mulan (?:permissive software )?licen[sc]e | (?:version |v )?v?2(?: 0)? | mulanpsl 2 0
    qpl-1.0 | q public | q public licen[sc]e | | qpl 1 0
    ipl-1.0 | ibm | ibm public licen[sc]e | | ipl 1 0
    apsl-2.0 | apple | apple public source licen[sc]e | | apsl 2 0
    lppl-1.3c | latex | latex project public licen[sc]e | | lppl 1 3c
    tcl | tcl | tcl tk licen[sc]e | | tcl
    w3c | w3c | w3c software(?: notice and)? licen[sc]e | | w3c
    unicode | unicode | unicode (?:data files and software )?licen[sc]e | | unicode dfs 2016
    curl | curl | curl licen[sc]e | | curl
    beerware | beer | beer ?ware licen[sc]e | | beerware
    json | json | json licen[sc]e | | json
    eiffel-2.0 | eiffel | eiffel forum licen[sc]e | | efl 2 0
    zpl-2.1 | zope | zope public licen[sc]e | (?:version |v )?v?2 1 | zpl 2 1
    zpl | zope | zope public licen[sc]e
    naist | nara institute | nara institute of science and technology licen[sc]e | | naist 2003
    etalab-2.0 | etalab | etalab open licen[sc]e | (?:version |v )?v?2(?: 0)? | etalab 2 0
    ogl-uk-3.0 | open government | open government licen[sc]e | (?:version |v )?v?3(?: 0)? | ogl uk 3 0
    ogl-uk | open government | open government licen[sc]e
    openrail | rail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[sc]e)?
    llama | llama | llama (?:2 |3 )?community licen[sc]e
    gemma | gemma | gemma terms of use
    cc0-1.0 | cc0 | cc0 | (?:version |v )?v?1 0(?: universal)? | cc0 1 0
    cc0 | cc0 | cc0(?: public domain dedication)?
    public-domain | public domain | (?:dedicated to|placed in|released into|in) the public domain
    all-rights-reserved | all rights | all rights reserved
    proprietary | proprietary | (?:proprietary and confidential|proprietary licen[sc]e)
    """),
]

#: Priority, confidence and pattern of each form; those without version for families without one.
_GRANT = (r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|offered|redistributed) "
          r"(?:under|by|according to) (?:the )?(?:terms of (?:the )?)?")


def _whole(pattern: str) -> str:
    """``pattern`` between words."""
    return f"(?<= ){pattern}(?= )"


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


def rules(families: Iterable[Family] = FAMILIES) -> list[Rule]:
    """All rules in order: of two on one place the earlier one wins."""
    out = []
    for f in families:
        full = f.name + (f"(?: licen[sc]e)? {f.version}" if f.version else "")
        if f.spdx:
            out.append(Rule(f.label, "spdx", _whole(f"spdx licen[sc]e identifier {f.spdx}"), 100, 1.0))
        out.append(Rule(f.label, f.keyword, _whole(_GRANT + full), 80, 0.95))
        if f.link:
            out.append(Rule(f.label, "org licenses", _whole(f.link), 70, 0.9))
        out.append(Rule(f.label, f.keyword, _whole(full), 60 if f.version else 40, 0.85 if f.version else 0.6))
    return sorted(out, key=lambda r: -r.priority)


def words_of(text: Column) -> Column:
    """The words of a text (null: none), a space before, between and after them."""
    low = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), UPPER, LOWER)
    return F.regexp_replace(low, GAPS, " ")


def _always(pattern: str, part: str) -> bool:
    """Whether every branch of ``pattern`` holds ``part``."""

    def needed(group: re.Match) -> str:
        return part if not group[2] and all(part in branch for branch in group[1].split("|")) else " "

    before = ""
    while before != pattern:  # innermost groups first
        before, pattern = pattern, re.sub(r"\(\?:([^()]*)\)(\?)?", needed, pattern)
    return part in pattern


def anchors(table: list[Rule]) -> list[str]:
    """Words of which every text with a match has one: the one all names share if every
    branch of the pattern holds it, or else the longest of the keyword."""
    return sorted({"licen" if _always(r.pattern, "licen") else max(r.keyword.split(" "), key=len) for r in table})


def likely(text: Column, table: list[Rule]) -> Column:
    """False only for texts without a match of any rule or base phrase.

    Looked up in the raw text, so that most texts are never rewritten.  All letters are
    lower-cased here, which leaves no ASCII match out.
    """
    low = F.lower(text)
    found = F.lit(False)
    for word in {"licen", *anchors(table)} - {"cc"}:
        found = found | low.contains(word)
    return found | (low.contains("cc") & low.rlike("cc" + GAPS + "by"))


def places(words: Column, pattern: Column) -> Column:
    """First and last word (from 0) of every match of ``pattern``, as an array of structs.

    Matches are marked in the text and read off its words, so the work is linear.
    """
    marked = F.split(F.regexp_replace(words, pattern, F.lit(f"{BEGIN}$0{END}")), " ")
    at = lambda found: F.filter(F.transform(marked, lambda w, i: F.when(found(w), i - 1)), lambda i: i.isNotNull())
    return F.arrays_zip(at(lambda w: w.startswith(BEGIN)).alias("first"), at(lambda w: w.endswith(END)).alias("last"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal(rows: list[Rule]) -> Column:
    """The rules of each keyword, as an array of structs; one constant expression."""
    of: dict[str, list[str]] = {}
    for n, r in enumerate(rows):
        of.setdefault(r.keyword, []).append(
            f"named_struct('nth', {n}, 'label', {_quoted(r.label)}, 'pattern', {_quoted(r.pattern)}, "
            f"'confidence', {r.confidence}D)")
    groups = [f"named_struct('keyword', {_quoted(k)}, 'rules', array({', '.join(found)}))" for k, found in of.items()]
    return F.expr(f"array({', '.join(groups)})")


def detect(words: Column, table: list[Rule]) -> Column:
    """All matches of all rules whose keyword the text has: label, first, last, nth, confidence."""
    present = F.filter(_literal(table), lambda g: words.contains(g["keyword"]))
    likely = F.flatten(F.transform(present, lambda g: F.filter(g["rules"], lambda r: F.rlike(words, r["pattern"]))))
    return F.flatten(F.transform(likely, lambda r: F.transform(
        places(words, r["pattern"]),
        lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), r["nth"].alias("nth"),
                           r["label"].alias("label"), r["confidence"].alias("confidence")))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once (a one-element list stands in for a let)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def suppress(found: Column) -> Column:
    """The detections that none other stands over, by place.

    One stands over those within its words: a wider one always, since it has read more of
    the same licence text, and of two on the same words the one of the earlier rule.
    By first word, then the farther last one, then rule, each comes after all that may
    stand over it, and falls if one before it ends where it ends or later.  The greatest
    end before it is known for its block of ``BLOCK``; only in the block are neighbours read.
    """
    order = lambda d: F.struct(
        d["first"].alias("first"), (-d["last"]).alias("back"), d["nth"].alias("nth"), d["label"].alias("label"),
        d["confidence"].alias("confidence"))
    plain = lambda d: F.struct(
        d["first"].alias("first"), (-d["back"]).alias("last"), d["nth"].alias("nth"), d["label"].alias("label"),
        d["confidence"].alias("confidence"))

    def cut(rows: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int"))
        some = F.when(F.size(rows) > 0, F.transform(numbers, lambda b: F.slice(rows, b * BLOCK + 1, BLOCK)))
        return F.transform(some, lambda b: F.struct(
            b.alias("rows"), F.array_min(F.transform(b, lambda d: d["back"])).alias("back")))

    def stay(block: Column, before: Column) -> Column:
        return F.filter(block, lambda d, i: ~(before <= d["back"]) & ~F.exists(
            F.slice(block, 1, i), lambda e: e["back"] <= d["back"]))

    def left(blocks: Column) -> Column:
        def of(block: Column, i: Column) -> Column:
            least = F.array_min(F.transform(F.slice(blocks, 1, i), lambda b: b["back"]))
            return _let(F.coalesce(least, F.lit(1)), lambda before: stay(block["rows"], before))

        return F.transform(F.flatten(F.transform(blocks, of)), plain)

    ordered = F.array_sort(F.transform(found, order))
    return F.coalesce(_let(ordered, lambda rows: _let(cut(rows), left)), found)


def scan_licenses(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """Words, base phrases, detections and labels of every document.

    ``detections`` holds label, first and last word, rule and confidence of all that stay
    after suppression; ``labels`` their labels and the base ones, distinct, sorted and
    joined by commas; ``score`` the highest confidence (a base phrase alone: 0.5; nothing:
    0).  Null texts count as empty and have none; null ids and repeated rows are ordinary
    rows; an empty table gives none.  Only ``doc_id`` and ``text`` are read.  No shuffle,
    no Python.
    """
    table = rules() if table is None else table
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(
        "doc_id", F.regexp_count(text, F.lit(WORD)).alias("n_words"), likely(text, table).alias("likely"), "text")
    docs = docs.select("doc_id", "n_words", "likely", F.when(F.col("likely"), words_of(F.col("text"))).alias("words"))

    def named(phrase: str, label: str) -> Column:
        at = places(F.col("words"), F.lit(_whole(phrase)))
        return F.when(F.col("words").contains(f" {phrase} "), F.transform(
            at, lambda p: F.struct(p["first"].alias("first"), F.lit(label).alias("label"))))

    base = [named(phrase, label) for phrase, label in BASE]
    nothing = F.expr("cast(array() AS array<struct<first: int, label: string>>)")
    none = F.expr("cast(array() AS array<struct<first: int, last: int, nth: int, label: string, confidence: double>>)")
    docs = docs.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.when(F.col("likely"), F.flatten(F.array(*[F.coalesce(b, nothing) for b in base]))).otherwise(nothing).alias("base"),
        F.when(F.col("likely"), detect(F.col("words"), table)).otherwise(none).alias("found"),
    )
    docs = docs.select("doc_id", "n_words", "base", suppress(F.col("found")).alias("detections"))
    starts = F.transform("base", lambda b: b["first"].cast("long"))
    names = F.array_distinct(F.transform("base", lambda b: b["label"]))
    more = F.transform("detections", lambda d: d["label"])
    sure = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)),
                      F.when(F.size("base") > 0, F.lit(0.5)).otherwise(0.0))
    return docs.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(names), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names, more)), ",").alias("labels"),
        sure.cast("double").alias("score"), "detections")
