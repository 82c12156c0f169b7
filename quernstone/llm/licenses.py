"""License scans by ordered signature rules, on DataFrame functions alone."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import body

#: A word is a run of ASCII digits, letters (lower-cased) or any character from U+0080 on.
WORD = "[0-9A-Za-z\u0080-\U0010ffff]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the base scan: phrase and label.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, keyword, pattern of the name in a text of lower-cased words with one space between them.
NAMES = (
    ("mit", "mit", "mit"),
    ("mit-0", "mit 0", "mit 0"),
    ("x11", "x11", "x11"),
    ("apache", "apache", "apache(?: software foundation)?"),
    ("gpl", "gnu", "gnu(?: gpl)?(?: general public)?"),
    ("gpl", "general public", "(?:gnu )?general public"),
    ("gpl", "gpl", "gpl(?:v[123])?"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public"),
    ("lgpl", "library general", "(?:gnu )?library general public"),
    ("lgpl", "lgpl", "lgpl(?:v[23])?"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("agpl", "agpl", "agpl(?:v3)?"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation"),
    ("bsd", "bsd", "(?:new |modified |simplified |revised )?bsd"),
    ("bsd-2-clause", "bsd", "(?:2 clause|two clause) bsd"),
    ("bsd-3-clause", "bsd", "(?:3 clause|three clause) bsd"),
    ("bsd-4-clause", "bsd", "(?:4 clause|four clause|original) bsd"),
    ("isc", "isc", "isc"),
    ("mpl", "mozilla", "mozilla public"),
    ("mpl", "mpl", "mpl"),
    ("epl", "eclipse", "eclipse public"),
    ("eupl", "european union", "european union public"),
    ("cddl", "common development", "common development and distribution"),
    ("artistic", "artistic", "artistic"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost", "boost", "boost(?: software)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("python", "python", "python(?: software foundation)?"),
    ("php", "php", "php"),
    ("ruby", "ruby", "ruby"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("ofl", "open font", "(?:sil )?open font"),
    ("odbl", "open database", "open database"),
    ("odc-by", "open data commons", "open data commons attribution"),
    ("ms-pl", "microsoft public", "microsoft public"),
    ("proprietary", "proprietary", "proprietary"),
    ("commercial", "commercial", "commercial"),
    ("cc0", "cc0", "cc0"),
    ("cc-by", "cc by", "cc by"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd"),
    ("cc-by", "creative commons", "creative commons attribution"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike"),
)

_VERSION = "(?: (?:version |v )?v?[0-9]+(?: [0-9]+)?(?: international| unported| only| or later)?)?"
_TAIL = "(?: public)?(?: licen[sc]e)?" + _VERSION
#: Confidence and pattern of the phrases that a name stands in, from the most to the least telling.
FRAMES = (
    (0.99, " spdx licen[sc]e identifier {n}" + _TAIL),
    (0.97, " (?:this|the) (?:work|file|software|program|project|document|text|page|code|content) (?:is|are) (?:dual |jointly )?(?:licen[sc]ed|released|distributed|made available|published|provided) under (?:the )?(?:terms of the )?{n}" + _TAIL),
    (0.95, " (?:licen[sc]ed|released|distributed|available|published|provided|covered|shared) (?:under|by) (?:the |an? )?(?:terms of the )?{n}" + _TAIL),
    (0.9, " (?:subject to|governed by|terms of|conditions of|accordance with|permitted by|copy of) the {n}" + _TAIL),
    (0.85, " {n}(?: public)? licen[sc]e" + _VERSION),
    (0.75, " licen[sc]e {n}" + _VERSION),
)
#: Statements that name no license: confidence, label, keyword, pattern.
PLAIN = (
    (0.7, "public-domain", "public domain", " (?:released|placed|dedicated|is|are)?(?: in| into| to)?(?: the)? public domain"),
    (0.6, "all-rights-reserved", "rights reserved", " all rights reserved"),
    (0.5, "copyright", "copyright", " copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
)

#: Label and pattern of passages of license texts, headers and notices, in words as above; hand-written, by confidence.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "use of this source code is governed by an mit style licen[sc]e"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software to deal in the software without restriction without attribution"),
    ("mit-modern", "permission is hereby granted without written agreement and without license or royalty fees"),
    ("x11", "except as contained in this notice the name of (?:the )?x consortium shall not be used in advertising"),
    ("x11", "copyright (?:c )?[0-9]{4} x consortium"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", "neither the names? of .{1,80} nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg"),
    ("bsd", "use of this source code is governed by a bsd style licen[sc]e that can be found in the license file"),
    ("bsd-2-clause-patent", "each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-1.1", "this product includes software developed by the apache software foundation .{0,40}alternately this acknowledg"),
    ("apache-1.1", "the names apache and apache software foundation must not be used to endorse or promote products .{0,60}written permission"),
    ("apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "(?:www )?apache org licenses license 2 0"),
    ("apache", "apache license version 2 0 january 2004"),
    ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("gpl", "is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", "either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3", "either version 3 of the license or (?:at your option )?any later version"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-3", "gnu general public license version 3 29 june 2007"),
    ("gpl-2", "gnu general public license version 2 june 1991"),
    ("gpl", "(?:www )?gnu org licenses gpl"),
    ("gpl-2-only", "under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl-classpath", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-gcc", "gcc runtime library exception"),
    ("gpl-bison", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton .{0,40}licen"),
    ("gpl-font", "as a special exception if you create a document which uses this font .{0,200}general public license"),
    ("lgpl", "is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this library"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("lgpl", "(?:www )?gnu org licenses lgpl"),
    ("agpl", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007"),
    ("agpl", "remote network interaction use with the gnu general public license"),
    ("agpl", "(?:www )?gnu org licenses agpl"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts .{0,60}license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at .{0,30}licen|mozilla org mpl 2 0 .{0,20}licen"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied"),
    ("mpl-1.1", "the initial developer of the original code is .{1,80}portions created by .{1,200}copyright"),
    ("npl", "the contents of this file are subject to the netscape public license"),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl", "(?:www )?eclipse org legal epl .{0,30}licen"),
    ("cpl", "the accompanying program is provided under the terms of this common public license"),
    ("ipl", "the accompanying program is provided under the terms of this ibm public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "you can obtain a copy of the license at .{0,80}(?:opensource|opensolaris|glassfish) org .{0,40}licen"),
    ("eupl", "licensed under the eupl"),
    ("eupl", "licen[sc]ed under the european union public licence"),
    ("osl", "licensed under the open software license version"),
    ("afl", "licensed under the academic free license version"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications .{0,120}redistribute"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software .{0,400}redistribut"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost", "boost org license 1 0 txt"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software .{0,300}public domain"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("wtfpl", "you just do what the fuck you want to .{0,60}licen"),
    ("beerware", "the beer ware license"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff .{0,200}licen"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("python", "psf is making python available to licensee on an as is basis .{0,80}warrant"),
    ("python", "this license agreement is between the python software foundation"),
    ("cnri", "cnri license agreement .{0,60}python"),
    ("php", "this product includes php software freely available from .{0,60}redistribut|redistributions of any form whatsoever must retain the following acknowledg"),
    ("php", "this source file is subject to version [0-9] [0-9]+ of the php license"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit .{0,200}redistribut"),
    ("openssl", "redistributions of any form whatsoever must retain the following acknowledgment this product includes software developed by the openssl project"),
    ("ssleay", "copyright remains eric young s"),
    ("curl", "copyright (?:c )?[0-9]{4} (?:[0-9]{4} )?daniel stenberg"),
    ("vim", "vim is charityware .{0,120}licen"),
    ("ruby", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("json", "the software shall be used for good not evil .{0,200}warrant"),
    ("ofl", "this font software is licensed under the sil open font license"),
    ("ofl", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("bitstream-vera", "permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license"),
    ("ubuntu-font", "ubuntu font licence version 1 0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "to the extent possible under law .{1,100}has waived all copyright and related or neighboring rights"),
    ("cc0", "creativecommons org publicdomain zero .{0,40}licen|cc0 1 0 universal .{0,60}licen"),
    ("cc-by", "creativecommons org licenses by [0-9]"),
    ("cc-by-sa", "creativecommons org licenses by sa"),
    ("cc-by-nd", "creativecommons org licenses by nd"),
    ("cc-by-nc", "creativecommons org licenses by nc [0-9]"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd"),
    ("cc", "the licensor offers the licensed material as is and as available"),
    ("cc", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("odbl", "this database is made available under the open database license"),
    ("odbl", "any rights in individual contents of the database are licensed under the database contents license"),
    ("odc-by", "this data is made available under the open data commons attribution license"),
    ("pddl", "made available under the public domain dedication and license"),
    ("cdla", "community data license agreement (?:permissive|sharing)"),
    ("ogl-uk", "contains public sector information licensed under the open government licence"),
    ("ms-pl", "microsoft public license ms pl"),
    ("ms-rl", "microsoft reciprocal license ms rl"),
    ("ms-eula", "these license terms are an agreement between (?:you and )?microsoft"),
    ("oracle-bcl", "oracle binary code license agreement"),
    ("oracle", "oracle technology network license agreement"),
    ("apple", "apple public source license"),
    ("apple-sample", "in consideration of your agreement to (?:abide by )?the following terms and subject to these terms apple grants you a personal non exclusive license"),
    ("nvidia", "nvidia corporation and its licensors retain all intellectual property and proprietary rights"),
    ("intel", "intel grants you a non exclusive worldwide non transferable .{0,60}licen"),
    ("unicode", "unicode inc license agreement data files and software"),
    ("w3c", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("w3c", "w3c software notice and license"),
    ("icu", "icu license icu 1 8 1 and later"),
    ("libpng", "the png reference library is supplied as is .{0,200}warrant"),
    ("ijg", "this software is based in part on the work of the independent jpeg group .{0,200}copyright"),
    ("freetype", "the freetype project license"),
    ("sissl", "sun industry standards source license"),
    ("sun", "sun microsystems inc gives you a non exclusive worldwide license"),
    ("zpl", "zope public license zpl version"),
    ("ecl", "licensed under the educational community license version"),
    ("upl", "the universal permissive license upl version 1 0"),
    ("mulan", "licensed under mulan psl v2"),
    ("sspl", "server side public license version 1"),
    ("busl", "business source license 1 1"),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("elastic", "elastic license 2 0"),
    ("elastic", "you may not use this file except in compliance with the elastic license"),
    ("confluent", "confluent community license agreement"),
    ("commons-clause", "commons clause license condition v1 0"),
    ("polyform", "polyform (?:noncommercial|small business|shield|perimeter|strict|free trial) license"),
    ("timescale", "timescale license agreement"),
    ("redis-sal", "redis source available license"),
    ("openrail", "responsible ai license .{0,40}openrail|creativeml open rail m .{0,40}licen"),
    ("llama-community", "community license agreement .{0,80}llama"),
    ("gemma", "gemma terms of use .{0,120}licen"),
    ("ncsa", "university of illinois ncsa open source license"),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("llvm-exception", "apache license v2 0 with llvm exceptions"),
    ("proprietary", "this software is the confidential and proprietary information of .{1,80}licen"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited .{0,80}copyright|copyright .{1,120}unauthorized copying of this file"),
    ("proprietary", "no part of this (?:publication|document|book|software) may be reproduced .{0,200}(?:copyright|permission)"),
    ("evaluation", "for evaluation purposes only .{0,80}licen"),
    ("non-commercial", "licensed for non ?commercial use only"),
    ("academic", "licensed for academic (?:and research )?use only"),
    ("warranty-disclaimer", "provided as is without warranty of any kind express or implied"),
    ("public-domain", "this (?:file|work|code|software) (?:is|has been placed) in the public domain"),
    ("public-domain", "the author disclaims copyright to this source code"),
    ("public-domain", "work of the united states government .{0,120}(?:public domain|copyright)"),
)
#: A text that holds none of these can hold no passage: every alternative of every pattern above has one of them.
TEXT_WORDS = ("licen", "redistribut", "copyright", "hereby", "warrant", "public domain", "liable", "permission", "acknowledg", "advertising", "runtime")

#: What every frame's pattern needs, whatever the name: a word of each group of one of these.
FRAME_WORDS = (
    (("licen",),),
    (("under", "by"), ("released", "distributed", "available", "published", "provided", "covered", "shared")),
    (("the",), ("subject", "governed", "terms", "conditions", "accordance", "permitted", "copy")),
)


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs over words with a space before each and after the last; a match starts with such a space."""

    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    base: bool = False
    words: int = 0


def rules(phrases: dict[str, str] = BASE_PHRASES) -> list[Rule]:
    """Every frame around every name, in order of priority, then plain statements; base phrases beside them."""
    made = []
    for phrase, label in phrases.items():
        words = phrase.split()
        # only the first word is consumed, so places that overlap count too
        rest = "".join(" " + w for w in words[1:])
        made.append(Rule(label, phrase, f" {words[0]}(?={rest} )", 99, 0.8, True, len(words)))
    for p, (confidence, frame) in enumerate(FRAMES):
        made += [Rule(label, keyword, frame.replace("{n}", f"(?:{name})") + "(?= )", p, confidence) for label, keyword, name in NAMES]
    made += [Rule(label, keyword, pattern + "(?= )", len(FRAMES), confidence) for confidence, label, keyword, pattern in PLAIN]
    return made + [Rule(label, fixed_words(pattern), f" (?:{pattern})(?= )", -1, 0.98) for label, pattern in TEXTS]


def fixed_words(pattern: str) -> str:
    """The longest run of whole words that every match of a pattern holds; empty where alternatives share none."""
    flat = re.sub(r"\(\?[:=][^()]*\)\??|\[[^]]*\][+*?]?(?:\{[^}]*\})?|\.\{[^}]*\}|.\?", "\n", pattern)
    if "|" in flat:
        return ""
    first, *later = flat.split("\n")
    # after something variable a run may begin inside a word
    return max([first, *[r[r.index(" ") :] for r in later if " " in r]], key=len).strip()


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def _all(low: Column, phrase: str) -> Column:
    """Whether every word of ``phrase`` stands somewhere, with whatever between them."""
    return reduce(and_, [F.contains(low, F.lit(w)) for w in phrase.split()])


def _gate(low: Column, phrases: dict[str, str]) -> Column:
    """What a lower-cased text must hold for any rule to match: its phrase's words, or those of a frame and of a name."""
    frames = _any([reduce(and_, [_any([F.contains(low, F.lit(w)) for w in group]) for group in groups]) for groups in FRAME_WORDS])
    names = _any([_all(low, k) for k in dict.fromkeys(k for _, k, _ in NAMES)])
    plain = [_all(low, k) for k in (*(k for _, _, k, _ in PLAIN), *phrases)]
    return _any([*plain, frames & names, *[F.contains(low, F.lit(w)) if " " not in w else _all(low, w) for w in TEXT_WORDS]])


_RULE = "nr int, label string, keyword string, pattern string, priority int, confidence double, base boolean, words int"


def _table(found: list[Rule]) -> Column:
    """The rules as one constant array; a row of nulls with number -1 stands for a text without any."""
    rows = [{"nr": -1, "base": False, "words": 0}, *[{"nr": nr, **vars(r)} for nr, r in enumerate(found)]]
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_RULE}>>")


def _spaces(c: str) -> Column:
    return F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit("")))


def scan(docs: DataFrame, id_col: str, text_col: str, phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """Detections of every whole text: (row, id, n_words, label, base, confidence, start, end, suppressed).

    Words count from 0, ends are exclusive. A document without any detection has one row with a null label. Texts without
    what the rules need cost one word count; in the others a rule's pattern is only tried where its own keyword
    stands. A detection is suppressed if another one that covers it begins earlier or ends later, or has the same
    place and a higher priority; base detections are never suppressed. A null text is empty. Repeated rows and null
    identifiers are kept apart by ``row``, the place of a row in the plan: save the result of a shuffle before it is
    scanned, as a lost executor may bring its rows back in another order. Other columns are not read.
    """
    text = body(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.translate(text, UPPER, LOWER).alias("low"))
    rows = rows.withColumn("gated", F.when(_gate(F.col("low"), phrases), F.col("low"))).drop("low")
    words = F.regexp_extract_all("gated", F.lit(WORD), F.lit(0))
    rows = rows.withColumn("norm", F.when(F.col("gated").isNotNull(), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))).drop("gated")
    found = rules(phrases)
    tried = F.filter(_table(found), lambda r: (r["nr"] < 0) | F.coalesce(F.contains(F.col("norm"), F.concat(F.lit(" "), r["keyword"])), F.lit(False)))
    each = rows.select("row", "id", "n_words", "norm", F.explode(tried).alias("r"))
    pairs = F.when(F.col("r.pattern").isNotNull(), F.arrays_zip(F.regexp_extract_all("norm", F.col("r.pattern"), F.lit(0)).alias("m"), F.split("norm", F.col("r.pattern"), -1).alias("gap")))
    places = each.select("row", "id", "n_words", "r", F.posexplode_outer(pairs).alias("k", "at")).where("r.nr < 0 or at.m is not null")
    places = places.select("row", "id", "n_words", "r.nr", "r.label", "r.priority", "r.confidence", "r.base", "r.words", "k", F.col("at.m").alias("m"), F.col("at.gap").alias("gap"))
    places = places.withColumn("hit", _spaces("m")).withColumn("skip", _spaces("gap")).drop("m", "gap").repartition("row")
    earlier = Window.partitionBy("row", "nr").orderBy("k")
    places = places.withColumn("start", F.sum(F.col("skip") + F.col("hit")).over(earlier) - F.col("hit"))
    places = places.withColumn("end", F.col("start") + F.when(F.col("words") > 0, F.col("words")).otherwise(F.col("hit")))
    outer = Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", "nr").rowsBetween(Window.unboundedPreceding, -1)
    suppressed = ~F.col("base") & F.coalesce(F.max(F.when(~F.col("base"), F.col("end"))).over(outer) >= F.col("end"), F.lit(False))
    return places.select("row", "id", "n_words", "label", "base", "confidence", "start", "end", suppressed.alias("suppressed"))


def summary(detections: DataFrame) -> DataFrame:
    """One row per document: (id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    base = F.col("base") & F.col("label").isNotNull()
    kept = F.col("label").isNotNull() & ~F.col("suppressed")
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return detections.groupBy("row").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(kept).alias("labels"), F.coalesce(F.max(F.when(kept, F.col("confidence"))), F.lit(0.0)).alias("score"),
    ).drop("row")
