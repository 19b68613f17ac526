"""Licence detection by ordered signature rules, in DataFrame functions only.

A text becomes its lower-cased words, each behind one space; rules are regular
expressions over that form.  A rule runs only where its keyword, the rarest of
its words, is among the document's words.  Every match is an interval of words.
Rules have a tier: 0 full notices, 1 grants and tags, 2 names, 3 general terms.  A
match inside the interval of another one of the same or a better tier is
suppressed; of matches with one interval the better tier, then the earlier
rule, stays.  Everything happens within the row: no shuffle, and no cap.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are always counted, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: (label, keyword, the name as a pattern of words)
FAMILIES = (
    ("apache", "apache", "apache(?: software)?"),
    ("mit", "mit", "mit"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("gpl", "gnu", "gnu general public"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public"),
    ("lgpl", "library", "(?:gnu )?library general public"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("gfdl", "gfdl", "(?:gnu )?gfdl"),
    ("gfdl", "documentation", "(?:gnu )?free documentation"),
    ("mpl", "mozilla", "mozilla public"),
    ("mpl", "mpl", "mpl"),
    ("epl", "eclipse", "eclipse public"),
    ("epl", "epl", "epl"),
    ("edl", "eclipse", "eclipse distribution"),
    ("cddl", "cddl", "cddl"),
    ("cddl", "distribution", "common development and distribution"),
    ("cpl", "common", "common public"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("bsd-2-clause", "freebsd", "freebsd"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "0bsd", "0bsd"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("libpng", "libpng", "libpng"),
    ("bsl", "boost", "boost software"),
    ("busl", "busl", "busl"),
    ("busl", "business", "business source"),
    ("sspl", "sspl", "sspl"),
    ("sspl", "server", "server side public"),
    ("elastic", "elastic", "elastic"),
    ("artistic", "artistic", "(?:perl )?artistic"),
    ("eupl", "eupl", "eupl"),
    ("eupl", "european", "european union public"),
    ("cecill", "cecill", "cecill(?: b| c)?"),
    ("osl", "osl", "osl"),
    ("osl", "open", "open software"),
    ("afl", "academic", "academic free"),
    ("ecl", "educational", "educational community"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("python", "python", "python(?: software foundation)?"),
    ("php", "php", "php"),
    ("ruby", "ruby", "ruby"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0", "cc0", "(?:creative commons )?cc0"),
    ("cc0", "zero", "creative commons zero"),
    ("cc-by-nc-nd", "nd", "(?:cc|creative commons) by nc nd"),
    ("cc-by-nc-sa", "sa", "(?:cc|creative commons) by nc sa"),
    ("cc-by-nc", "nc", "(?:cc|creative commons) by nc"),
    ("cc-by-nd", "nd", "(?:cc|creative commons) by nd"),
    ("cc-by-sa", "sa", "(?:cc|creative commons) by sa"),
    ("cc-by", "by", "(?:cc|creative commons) by"),
    ("cc-by-nc", "attribution", "creative commons attribution non ?commercial"),
    ("cc-by-sa", "attribution", "creative commons attribution share ?alike"),
    ("cc-by", "attribution", "creative commons attribution"),
    ("odbl", "odbl", "odbl"),
    ("odbl", "database", "open (?:data commons open )?database"),
    ("ogl", "government", "open government"),
    ("ofl", "ofl", "(?:sil )?ofl"),
    ("ofl", "font", "(?:sil )?open font"),
    ("w3c", "w3c", "w3c(?: software)?(?: notice)?"),
    ("x11", "x11", "x11"),
    ("vim", "vim", "vim"),
    ("mulan-psl", "mulan", "mulan(?: permissive software)?"),
    ("rail", "openrail", "(?:big(?:science|code) )?openrail(?: m)?"),
    ("llama", "llama", "llama \\d+ community"),
)

_VERSION = "(?: (?:version |v)?\\d+(?: \\d+)*(?: or later| only)?)?"
_WORD = "(?: licen[cs]e)?"

#: (tier, confidence, pattern around a family's name)
_FORMS = (
    (1, 1.0, "spdx licen[cs]e identifier {name}" + _VERSION),
    (1, 0.95, "(?:licen[cs]ed|released|distributed|published|available|made available|covered|provided|offered|governed) (?:under|by)"
              "(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the)? {name}" + _WORD + _VERSION + _WORD),
    (1, 0.9, "(?:terms|conditions|provisions) of(?: the)? {name}" + _WORD + _VERSION + _WORD),
    (1, 0.9, "(?:subject to|under)(?: the)? {name} licen[cs]e" + _VERSION),
    (2, 0.8, "{name} licen[cs]e" + _VERSION),
    (2, 0.75, "(?:licen[cs]e (?:is )?{name}" + _VERSION + "|{name}" + _VERSION + " licen[cs]ed)"),
    (2, 0.7, "(?:opensource org licen[cs]es|spdx org licen[cs]es|creativecommons org licen[cs]es|gnu org licen[cs]es) {name}" + _VERSION),
)

#: (label, words before, the name and its version as one word)
FUSED = (
    ("gpl", "(?:gnu )?", "gplv1 gplv2 gplv3 gpl1 gpl2 gpl3"), ("lgpl", "(?:gnu )?", "lgplv2 lgplv3 lgpl2 lgpl21 lgpl3"),
    ("agpl", "(?:gnu )?", "agplv1 agplv3 agpl3"), ("gfdl", "(?:gnu )?", "gfdlv1"), ("apache", "", "apachev2 apache2 asl2 aslv2"),
    ("mpl", "", "mplv1 mplv2 mpl1 mpl2"), ("epl", "", "eplv1 eplv2 epl1 epl2"), ("cddl", "", "cddlv1"),
    ("eupl", "", "euplv1"), ("osl", "", "oslv3 osl3"), ("bsd-2-clause", "", "bsd2"), ("bsd-3-clause", "", "bsd3"),
)

#: (label, keyword, tier, confidence, pattern) of notices with wordings of their own
NOTICES = (
    ("mit", "hereby", 0, 1.0, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "merchantability", 3, 0.3, "without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("bsd", "redistribution", 0, 1.0, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", 0, 0.9, "neither the name of .{1,80}? nor the names of its contributors may be used to endorse"),
    ("bsd-3-clause", "endorse", 0, 0.9, "nor the names of (?:its |their |any |the )?contributors may be used to endorse"),
    ("bsd", "endorse", 1, 0.8, "may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", 0, 0.9, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsl", "accompanying", 0, 1.0, "any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("postgresql", "fee", 0, 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("apache", "applicable", 0, 0.9, "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("mpl", "mozilla", 0, 0.9, "the contents of this file are subject to the mozilla public license"),
    ("cddl", "subject", 0, 0.9, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl", "eclipse", 0, 0.9, "made available under the terms of the eclipse public license"),
    ("ofl", "font", 0, 0.9, "this font software is licensed under the sil open font license"),
    ("unlicense", "compile", 0, 0.9, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "deed", 0, 0.9, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("openssl", "openssl", 0, 0.9, "this product includes software developed by the openssl project"),
    ("php", "php", 0, 0.9, "this product includes php software"),
    ("python", "psf", 0, 0.9, "psf is making python available to licensee"),
    ("isc", "fee", 0, 1.0, "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("zlib", "origin", 0, 0.9, "the origin of this software must not be misrepresented"),
    ("gpl", "redistribute", 0, 0.9, "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "lesser", 0, 0.9, "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "affero", 0, 0.9, "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "general", 2, 0.8, "(?:gnu )?general public licen[cs]e" + _VERSION),
    ("apache", "www", 0, 0.9, "www apache org licenses license 2 0"),
    ("mpl", "mozilla", 0, 1.0, "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", 0, 1.0, "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", 0, 0.9, "do what the fuck you want to public license"),
    ("public-domain", "domain", 1, 0.8, "(?:in|into|to) the public domain"),
    ("public-domain", "domain", 1, 0.8, "public domain dedication"),
    ("reserved", "reserved", 2, 0.6, "(?:all|some) rights? reserved"),
    ("reserved", "reproduced", 2, 0.6, "may not be reproduced"),
    ("reserved", "copied", 2, 0.6, "may not be copied"),
    ("reserved", "distributed", 2, 0.6, "may not be distributed"),
    ("reserved", "permission", 2, 0.5, "without (?:the )?(?:prior )?(?:express )?(?:written )?permission of"),
    ("copyright", "copyright", 3, 0.4, "copyright(?: c| ©)?(?: ©?\\d{4})+"),
    ("copyright", "©", 3, 0.4, "©(?: copyright)?(?: \\d{4})+"),
    ("copyright", "copyright", 3, 0.3, "copyright(?: c| ©)? by"),
    ("proprietary", "proprietary", 2, 0.7, "proprietary and confidential"),
    ("proprietary", "confidential", 2, 0.5, "confidential information of"),
    ("non-commercial", "commercial", 2, 0.6, "for non commercial (?:use|purposes) only"),
    ("non-commercial", "noncommercial", 2, 0.6, "for noncommercial (?:use|purposes) only"),
    ("warranty", "warranty", 3, 0.2, "without warranty of any kind"),
    ("warranty", "warranties", 3, 0.2, "without warranties or conditions of any kind"),
    ("unknown-license", "licensed", 3, 0.2, "licensed under"),
    ("unknown-license", "license", 3, 0.2, "(?:see|read) the license"),
    ("unknown-license", "licence", 3, 0.2, "(?:see|read) the licence"),
)


#: Clauses and notices in each licence's own words; fixed values: (label, keyword, tier, confidence, pattern)
WORDINGS = (
    ("apache", "perpetual", 0, 0.9, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache", "prominent", 0, 0.9, "you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache", "contributor", 0, 0.9, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", "apache", 0, 0.8, "this product includes software developed (?:by|at) the apache software foundation"),
    ("mit", "substantial", 0, 0.9, "this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "sublicense", 0, 0.9, "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("x11", "consortium", 0, 0.9, "the name of the x consortium shall not be used in advertising or otherwise"),
    ("hpnd", "suitability", 0, 0.8, "makes no representations about the suitability of this software for any purpose"),
    ("hpnd", "supporting", 0, 0.8, "copyright notice and this permission notice appear in supporting documentation"),
    ("bsd", "retain", 0, 0.9, "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", "redistributions", 0, 0.9, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "exemplary", 0, 0.7, "be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3-clause-clear", "patent", 0, 0.9, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", "berkeley", 0, 0.9, "this product includes software developed by the university of california berkeley"),
    ("zlib", "altered", 0, 0.9, "altered source versions must be plainly marked as such"),
    ("zlib", "arising", 0, 0.8, "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("gpl", "hope", 0, 0.8, "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received", 0, 0.8, "you should have received a copy of the gnu general public license along with this"),
    ("gpl", "copyleft", 0, 0.9, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "freedom", 0, 0.8, "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gnu", "verbatim", 1, 0.5, "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("lgpl", "received", 0, 0.8, "you should have received a copy of the gnu (?:lesser|library) general public license along with this"),
    ("lgpl", "supplemented", 0, 0.9, "version 3 of the gnu general public license supplemented by the additional permissions"),
    ("agpl", "remotely", 0, 0.9, "must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "invariant", 0, 0.9, "with no invariant sections no front cover texts and no back cover texts"),
    ("classpath-exception", "statically", 0, 0.9, "linking this library statically or dynamically with other modules is making a combined work"),
    ("gcc-exception", "propagate", 0, 0.9, "you have permission to propagate a work of target code formed by combining the runtime library"),
    ("autoconf-exception", "autoconf", 0, 0.8, "contains a configuration script generated by autoconf"),
    ("mpl", "mpl", 0, 0.9, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "incompatible", 0, 0.9, "this source code form is incompatible with secondary licenses"),
    ("cddl", "opensolaris", 0, 0.8, "you can obtain a copy of the license at usr src opensolaris license"),
    ("epl", "recipient", 0, 0.8, "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("bsl", "processor", 0, 0.9, "machine executable object code generated by a source language processor"),
    ("ms-pl", "accept", 0, 0.8, "if you use the software you accept this license if you do not accept the license do not use the software"),
    ("artistic", "verbatim", 0, 0.9, "you may make and give away verbatim copies of the source form of the standard version of this package"),
    ("beerware", "beer", 0, 0.9, "if we meet some day and you think this stuff is worth it you can buy (?:me|us) a beer in return"),
    ("json", "evil", 0, 0.9, "the software shall be used for good not evil"),
    ("ssleay", "cryptographic", 0, 0.9, "this product includes cryptographic software written by eric young"),
    ("libpng", "png", 0, 0.8, "the png reference library is supplied as is"),
    ("libtiff", "sell", 0, 0.8, "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("ijg", "jpeg", 0, 0.9, "based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", 0, 0.9, "portions of this software are copyright(?: c)?(?: \\d{4})* the freetype project"),
    ("unicode", "unicode", 0, 0.9, "any person obtaining a copy of the unicode data files and any associated documentation"),
    ("ncsa", "deal", 0, 0.7, "to deal with the software without restriction"),
    ("w3c", "viewable", 0, 0.9, "the full text of this notice in a location viewable to users of the redistributed or derivative work"),
    ("python", "beopen", 0, 0.9, "beopen is making the software available to licensee"),
    ("python", "cnri", 0, 0.9, "cnri is making python(?: \\d+)* available to licensee"),
    ("ofl", "font", 0, 0.9, "no modified version of the font software may use the reserved font name"),
    ("ofl", "bundled", 0, 0.9, "original or modified versions of the font software may be bundled redistributed and or sold with any software"),
    ("cc0", "waiving", 0, 0.9, "by waiving all of (?:his or her|their) rights to the work worldwide under copyright law"),
    ("cc-by", "credit", 1, 0.8, "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "remix", 1, 0.9, "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", "remix", 1, 0.9, "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-nc", "commercial", 1, 0.8, "you may not use the material for commercial purposes"),
    ("odbl", "database", 0, 0.9, "this (?:[a-z]+ )?database is made available under the open database licen[cs]e"),
    ("pddl", "dedication", 0, 0.9, "made available under the public domain dedication and licen[cs]e"),
    ("ogl", "sector", 0, 0.9, "contains public sector information licensed under the open government licen[cs]e"),
    ("elastic", "hosted", 0, 0.9, "you may not provide the software to third parties as a hosted or managed service"),
    ("sspl", "functionality", 0, 0.9, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl", "production", 0, 0.9, "create derivative works redistribute and make non production use of the licensed work"),
    ("commons-clause", "sell", 0, 0.9, "the license does not grant to you the right to sell the software"),
    ("polyform", "polyform", 2, 0.8, "polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license"),
    ("rail", "derivatives", 0, 0.8, "you agree not to use the model or derivatives of the model"),
    ("gemma", "gemma", 1, 0.8, "gemma is provided under and subject to the gemma terms of use"),
    ("cecill", "abiding", 0, 0.9, "under french law and abiding by the rules of distribution of free software"),
    ("mulan-psl", "mulan", 0, 0.9, "you can use this software according to the terms and conditions of the mulan psl"),
    ("postgresql", "paragraphs", 0, 0.9, "the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("php", "php", 0, 0.9, "products derived from this software may not be called php"),
    ("vim", "charityware", 0, 0.8, "vim is charityware"),
    ("info-zip", "individuals", 0, 0.9, "info zip is defined as the following set of individuals"),
    ("unlicense", "jurisdictions", 0, 0.9, "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"),
    ("public-domain", "claimed", 1, 0.7, "no copyright is claimed"),
    ("us-government-work", "government", 1, 0.7, "is a work of the (?:united states|u s) government"),
    ("proprietary", "disassemble", 1, 0.7, "may not (?:copy modify )?reverse engineer decompile or disassemble"),
    ("proprietary", "unauthorized", 1, 0.7, "unauthorized (?:copying|reproduction|use|duplication|distribution) of this (?:file|software|document|material)"),
    ("proprietary", "secrets", 1, 0.6, "contains (?:trade secrets|proprietary information and trade secrets)"),
    ("proprietary", "evaluation", 2, 0.5, "for evaluation (?:use|purposes) only"),
    ("proprietary", "user", 2, 0.5, "end user licen[cs]e agreement"),
)


def rules() -> list[dict]:
    """All rules in order; ``base`` marks the phrases that are always counted."""
    out = [{"label": label, "keyword": max(phrase.split(), key=len), "tier": 2, "score": 0.6, "base": True, "pattern": phrase}
           for phrase, label in BASE]
    out += [{"label": label, "keyword": kw, "tier": tier, "score": score, "base": False, "pattern": p}
            for label, kw, tier, score, p in NOTICES + WORDINGS]
    out += [{"label": label, "keyword": kw, "tier": tier, "score": score, "base": False, "pattern": form.replace("{name}", name)}
            for tier, score, form in _FORMS for label, kw, name in FAMILIES]
    out += [{"label": label, "keyword": word, "tier": 2, "score": 0.75, "base": False, "pattern": before + word + "(?: \\d+)*(?: or later| only)?"}
            for label, before, words in FUSED for word in words.split()]
    # names that mean nothing else stand for themselves
    out += [{"label": label, "keyword": kw, "tier": 2, "score": 0.75, "base": False, "pattern": name + _VERSION}
            for label, kw, name in FAMILIES if label.startswith("cc")]
    for k, rule in enumerate(out):
        rule |= {"id": k, "regex": f" (?:{rule['pattern']})(?= )"}
    return out


def normal_form(text: Column) -> Column:
    """Lower-cased words, each behind one space, and a space at the end."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


_FOUND = "array<struct<start:int,neg_end:int,tier:int,rule:int,label:string,score:double,base:boolean>>"


def _intervals(norm: Column, cand: Column) -> Column:
    """The matches of one rule, from left to right."""
    pieces = F.split(norm, cand["r"]["regex"], -1)
    both = F.zip_with(cand["ms"], F.slice(pieces, F.lit(1), F.size(cand["ms"])), lambda m, p: F.struct(
        _spaces(p).alias("skip"), _spaces(m).alias("n")))

    def step(acc, x):
        start = acc["at"] + x["skip"]
        end = start + x["n"]
        one = F.struct(start.alias("start"), (-end).alias("neg_end"), cand["r"]["tier"].alias("tier"), cand["r"]["id"].alias("rule"),
                       cand["r"]["label"].alias("label"), cand["r"]["score"].alias("score"), cand["r"]["base"].alias("base"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).cast(_FOUND).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))
    return F.aggregate(both, first, step, lambda acc: acc["out"])


def _resolve(found: Column) -> Column:
    """Suppress what lies inside an interval of the same or a better tier.  In
    order of start, longest first, what may hold a match comes before it, so the
    furthest end seen at each tier decides."""

    def step(acc, d):
        end = -d["neg_end"]
        held = F.lit(False)
        for t in range(4):
            held = held | ((d["tier"] >= t) & (acc[f"m{t}"] >= end))
        return F.struct(*[F.when(d["tier"] == t, F.greatest(acc[f"m{t}"], end)).otherwise(acc[f"m{t}"]).alias(f"m{t}") for t in range(4)],
                        F.when(held, acc["out"]).otherwise(F.concat(acc["out"], F.array(d)).cast(_FOUND)).alias("out"))

    first = F.struct(*[F.lit(0).alias(f"m{t}") for t in range(4)], F.array().cast(_FOUND).alias("out"))
    return F.aggregate(F.array_sort(found), first, step, lambda acc: acc["out"])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``n_words``, ``base`` (all places of the
    base phrases) and ``kept`` (the detections that stay), both arrays of
    (start, end, tier, rule, label, score) in words from 0.

    Null and empty texts have no words and no detections.  Null ids and repeated
    rows are kept as they are; an empty table gives no rows; other columns are
    not read.
    """
    all_rules = rules()
    # one constant each: a column per field of every rule takes the driver half a minute
    literal = F.from_json(F.lit(json.dumps(all_rules)), "array<struct<id:int,keyword:string,regex:string,tier:int,label:string,score:double,base:boolean>>")
    keywords = F.split(F.lit(" ".join(sorted({r["keyword"] for r in all_rules}))), " ")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    normed = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), normal_form(text).alias("norm"))
    hits = normed.select("id", "norm", F.array_intersect(F.split("norm", " "), keywords).alias("hits"),
                         F.greatest(_spaces(F.col("norm")) - 1, F.lit(0)).cast("long").alias("n_words"))
    tried = F.transform(F.filter(literal, lambda r: F.array_contains(F.col("hits"), r["keyword"])),
                        lambda r: F.struct(r.alias("r"), F.regexp_extract_all(F.col("norm"), r["regex"], F.lit(0)).alias("ms")))
    found = F.flatten(F.transform(F.filter(tried, lambda c: F.size(c["ms"]) > 0), lambda c: _intervals(F.col("norm"), c)))
    none = F.array().cast(_FOUND)
    with_found = hits.select("id", "n_words", F.when(F.size("hits") > 0, found).otherwise(none).alias("found"))

    def shown(col: Column) -> Column:
        return F.transform(col, lambda d: F.struct(d["start"], (-d["neg_end"]).alias("end"), d["tier"], d["rule"], d["label"], d["score"]))

    some = F.size("found") > 0
    return with_found.select(
        "id", "n_words", shown(F.when(some, F.array_sort(F.filter("found", lambda d: d["base"]))).otherwise(none)).alias("base"),
        shown(F.when(some, _resolve(F.col("found"))).otherwise(none)).alias("kept"))
