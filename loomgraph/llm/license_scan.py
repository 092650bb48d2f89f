"""License scans: ordered signature rules gated by keywords, resolved by priority and interval containment. Column expressions only.

A text becomes its lower-cased words joined by single blanks, with a blank before and after. A rule is a regular expression
over that string, with a label, a priority (1 first) and a confidence; it runs only where its keywords stand in the string.
Rules are the hand-written SIGNATURES, and the hand-written forms FORMS of the hand-written names NAMES. A detection is the run of
words that a rule matches. It is suppressed if another detection of the same or a better priority covers it (of equal ones
the rule that comes first stays). The base phrases are rules too; their labels stay even where they are suppressed.

Patterns are literals, compiled once. A keyword is looked for as bytes, once a text; a name's rules run if one of its own words
is there, and of these the forms whose word is there. Where a rule matches, its matches are marked in the string, whose words
then tell all places in one pass; detections are sorted, and resolved in parts of PART, so time grows little faster than matches.

Defined cases: a null or empty text has no words, no labels and score 0. All rows stay, whatever their ids; columns that
aren't named are passed on by scan(), whatever their names. Words are lower-cased as Unicode text for the rules, which changes
no base phrase. Each row is worked on by itself, whole and however long, so nothing is shuffled or gathered.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table, unused

#: What separates words, before lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Detections that are resolved together.
PART = 128

# Fixed values of the contract: phrase, label.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

LICENSE = "licen[sc]e"
VERSION = "(?: version)?(?: v)?"
#: label, name as words, what one of its matches must hold (alternatives between bars; a word's start, or a whole word before a
#: blank), whether the name alone is a detection.
NAMES = [
    ("apache-1.1", f"apache(?: software)?(?: {LICENSE})?{VERSION} (?:v?1 1)", "apache ", True),
    ("apache-2.0", f"apache(?: software)?(?: {LICENSE})?{VERSION} (?:v?2(?: 0)?)", "apache ", True),
    ("apache", "apache(?: software)?", "apache ", False),
    ("mit", "(?:mit|expat)", "mit |expat ", False),
    ("mit-0", "mit (?:0|no attribution)", "mit 0 |mit no ", False),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd |freebsd ", True),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd ", True),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd ", True),
    ("bsd", "bsd(?: style)?", "bsd ", False),
    ("isc", "isc", "isc ", False),
    ("zlib", "(?:zlib|libpng)", "zlib |libpng ", False),
    ("boost", f"(?:boost software|bsl 1 0)", "boost software |bsl ", False),
    ("mpl-1.1", f"(?:mozilla public(?: {LICENSE})?|mpl){VERSION} v?1 1", "mozilla public |mpl ", True),
    ("mpl-2.0", f"(?:mozilla public(?: {LICENSE})?|mpl){VERSION} v?2(?: 0)?", "mozilla public |mpl ", True),
    ("mpl", "(?:mozilla public|mpl)", "mozilla public |mpl ", False),
    ("epl-1.0", f"(?:eclipse public(?: {LICENSE})?|epl){VERSION} v?1 0", "eclipse public |epl ", True),
    ("epl-2.0", f"(?:eclipse public(?: {LICENSE})?|epl){VERSION} v?2 0", "eclipse public |epl ", True),
    ("cddl", "(?:common development and distribution|cddl)", "common development |cddl ", False),
    ("eupl", "(?:european union public|eupl)", "european union |eupl ", False),
    ("gpl-1.0", f"(?:(?:gnu )?general public {LICENSE}|gnu gpl|gpl){VERSION} v?1(?: 0)?", "general public |gpl ", True),
    ("gpl-2.0", f"(?:(?:gnu )?general public {LICENSE}|gnu gpl|gpl){VERSION} v?2(?: 0)?(?: or later| only)?", "general public |gpl ", True),
    ("gpl-3.0", f"(?:(?:gnu )?general public {LICENSE}|gnu gpl|gpl){VERSION} v?3(?: 0)?(?: or later| only)?", "general public |gpl ", True),
    ("gpl", f"(?:(?:gnu )?general public(?: {LICENSE})?|gnu gpl)", "general public |gpl ", True),
    ("lgpl-2.1", f"(?:(?:gnu )?(?:lesser|library) general public {LICENSE}|lgpl){VERSION} v?2(?: 1)?", "general public |lgpl ", True),
    ("lgpl-3.0", f"(?:(?:gnu )?lesser general public {LICENSE}|lgpl){VERSION} v?3(?: 0)?", "general public |lgpl ", True),
    ("lgpl", f"(?:(?:gnu )?(?:lesser|library) general public(?: {LICENSE})?|lgpl)", "general public |lgpl ", True),
    ("agpl-3.0", f"(?:(?:gnu )?affero general public {LICENSE}|agpl){VERSION} v?3(?: 0)?", "affero |agpl ", True),
    ("agpl", f"(?:(?:gnu )?affero general public(?: {LICENSE})?|agpl)", "affero |agpl ", True),
    ("gfdl", f"(?:gnu free documentation(?: {LICENSE})?|gfdl)", "free documentation |gfdl ", True),
    ("cc0", "(?:cc0|creative commons zero|cc zero)(?: 1 0)?(?: universal)?", "cc0 |cc zero |creative commons ", True),
    ("cc-by-4.0", "(?:cc by|creative commons attribution) (?:international )?4 0", "cc by |creative commons ", True),
    ("cc-by-3.0", "(?:cc by|creative commons attribution) (?:unported )?3 0", "cc by |creative commons ", True),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", "cc by |creative commons ", True),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", "cc by |creative commons ", True),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] [05])?", "cc by |creative commons ", True),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", "cc by |creative commons ", True),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [05])?", "cc by |creative commons ", True),
    ("cc", "creative commons", "creative commons ", True),
    ("odbl", "(?:open database|odbl)", "open database |odbl ", False),
    ("odc-by", "(?:open data commons attribution|odc by)", "odc by |open data ", True),
    ("pddl", "(?:public domain dedication and|pddl)", "public domain |pddl ", False),
    ("unlicense", "(?:the )?unlicense", "unlicense ", True),
    ("wtfpl", "wtfpl", "wtfpl ", True),
    ("artistic-2.0", f"(?:perl )?artistic(?: {LICENSE})?{VERSION} 2(?: 0)?", "artistic ", True),
    ("artistic", "(?:perl )?artistic", "artistic ", False),
    ("ofl-1.1", f"(?:sil )?open font(?: {LICENSE})?(?:{VERSION} 1 1)?", "open font ", True),
    ("python-2.0", "(?:python software foundation|psf)", "python software |psf ", False),
    ("postgresql", "postgresql", "postgresql ", False),
    ("ms-pl", "(?:microsoft public|ms pl)", "microsoft public |ms pl ", False),
    ("ncsa", "(?:university of illinois ncsa|ncsa)(?: open source)?", "university of |ncsa ", False),
    ("afl-3.0", "(?:academic free|afl)", "academic free |afl ", False),
    ("osl-3.0", "(?:open software|osl)", "open software |osl ", False),
]
#: form, what it must hold (as above; None: nothing but the name), priority, confidence; the last is the name alone.
FORMS = [
    ("(?:dual )?licen[sc]ed under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: licen[sc]e)?", "licen", 1, 1.0),
    ("(?:released|published|distributed|available|provided|offered|issued) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: licen[sc]e)?", "under ", 1, 1.0),
    ("(?:subject to|governed by|covered by|according to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: licen[sc]e)?", "subject to |governed by |covered by |according to ", 1, 0.95),
    ("spdx licen[sc]e identifier {name}", "spdx ", 1, 1.0),
    ("(?:terms|text|copy) of (?:the )?{name} licen[sc]e", "licen", 2, 0.85),
    ("{name} (?:public )?licen[sc]e(?:d)?", "licen", 2, 0.8),
    ("licen[sc]e(?: type| name)? {name}", "licen", 2, 0.75),
    ("{name}", None, 3, 0.6),
]
#: label, what a match must hold (as above), priority, confidence, expression
SIGNATURES = [
    # permission texts
    ("mit", "hereby granted ", 1, 1.0, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "to deal in ", 2, 0.9, "to deal in the software without restriction"),
    ("mit", "use copy ", 2, 0.85, "rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies"),
    ("mit", "substantial portions ", 2, 0.7, "included in all copies or substantial portions of the software"),
    ("mit", "mit ", 2, 0.7, "mit (?:x11|style|like|compatible)"),
    ("mit", "x11 ", 2, 0.7, "x11 licen[sc]e"),
    ("mit", "massachusetts ", 2, 0.6, "massachusetts institute of technology licen[sc]e"),
    ("isc", "permission to ", 1, 1.0, "permission to use copy modify and or distribute this software"),
    ("isc", "isc ", 2, 0.7, "isc (?:style|compatible)"),
    ("isc", "internet systems |internet software ", 2, 0.6, "internet (?:systems|software) consortium licen[sc]e"),
    ("hpnd", "permission to ", 1, 0.9, "permission to use copy modify and distribute this software and its documentation"),
    ("0bsd", "zero clause |0bsd |0 clause ", 1, 0.9, "(?:zero clause bsd|0 clause bsd|0bsd)"),
    ("bsd", "redistribution and ", 1, 1.0, "redistribution and use in source and binary forms with or without modification"),
    ("bsd", "redistributions of ", 2, 0.85, "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in ", 2, 0.85, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or ", 1, 0.9, "names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "neither the ", 1, 0.85, "neither the name of (?:the )?(?:[^ ]+ ){1,6}?nor the names of its contributors"),
    ("bsd-4-clause", "advertising materials ", 1, 0.9, "all advertising materials mentioning features or use of this software"),
    ("bsd-2-clause-patent", "bsd ", 2, 0.8, "bsd (?:2 clause )?plus patent"),
    ("bsd", "bsd ", 2, 0.6, "bsd (?:like|compatible|type)"),
    ("zlib", "origin of ", 1, 0.95, "the origin of this software must not be misrepresented"),
    ("zlib", "altered source ", 1, 0.9, "altered source versions must be plainly marked"),
    ("zlib", "be held ", 3, 0.4, "in no event will the authors be held liable"),
    ("boost", "organization obtaining ", 1, 0.95, "to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost", "boost org ", 2, 0.7, "boost org license(?: 1 0)?"),
    ("curl", "curl ", 2, 0.7, "curl licen[sc]e"),
    ("ntp", "ntp ", 2, 0.6, "ntp licen[sc]e"),
    ("x11-distribute", "advertising or ", 2, 0.6, "shall not be used in advertising or otherwise to promote the sale"),
    ("postgresql", "without fee ", 1, 0.8, "for any purpose without fee and without a written agreement is hereby granted"),
    ("python-2.0", "python software ", 1, 0.9, "python software foundation licen[sc]e(?: agreement)?"),
    ("python-2.0", "beopen ", 2, 0.7, "beopen python open source licen[sc]e"),
    ("php-3.01", "php ", 2, 0.8, "php licen[sc]e(?: version)?(?: 3(?: 0)?1?)?"),
    ("openssl", "openssl ", 1, 0.85, "(?:openssl licen[sc]e|openssl toolkit|developed by the openssl project)"),
    ("ssleay", "eric young ", 2, 0.7, "cryptographic software written by eric young"),
    ("ruby", "ruby ", 2, 0.6, "ruby licen[sc]e"),
    ("perl", "perl ", 1, 0.85, "(?:same terms as|under the same terms as) perl(?: itself)?"),
    ("artistic", "package ", 2, 0.6, "standard version of the package"),
    ("vim", "vim ", 2, 0.7, "vim licen[sc]e"),
    ("tcl", "tcl ", 2, 0.7, "tcl(?: tk)? licen[sc]e"),
    ("libpng", "png ", 2, 0.7, "png reference library licen[sc]e"),
    ("ijg", "independent jpeg ", 2, 0.7, "(?:based in part on the )?work of the independent jpeg group"),
    ("freetype", "freetype ", 2, 0.8, "freetype (?:project )?licen[sc]e"),
    ("icu", "icu ", 2, 0.7, "icu licen[sc]e"),
    ("unicode", "unicode ", 2, 0.8, "unicode (?:inc )?licen[sc]e(?: agreement)?"),
    ("w3c", "w3c ", 2, 0.8, "w3c (?:software )?(?:notice and )?(?:document )?licen[sc]e"),
    ("json", "for good ", 1, 0.9, "shall be used for good not evil"),
    ("beerware", "beer |beerware |buy me ", 1, 0.9, "(?:beer ?ware licen[sc]e|buy me a beer in return)"),
    ("wtfpl", "fuck ", 1, 0.95, "do what the fuck you want to public licen[sc]e"),
    ("unlicense", "unencumbered ", 1, 0.95, "free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense ", 2, 0.8, "unlicense org"),
    ("ms-rl", "microsoft reciprocal |ms rl ", 2, 0.8, "(?:microsoft reciprocal licen[sc]e|ms rl)"),
    # apache, mozilla, eclipse and others with files of their own
    ("apache-2.0", "apache org ", 1, 0.95, "(?:http )?(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", "compliance with ", 2, 0.7, "you may not use this file except in compliance with the licen[sc]e"),
    ("apache", "asf |apache ", 2, 0.7, "licen[sc]ed to the (?:apache software foundation|asf)(?: asf)? under one or more"),
    ("apache", "contributor license ", 2, 0.6, "contributor license agreements"),
    ("apache", "apache ", 2, 0.6, "apache (?:2|style|like) licen[sc]e"),
    ("mpl-2.0", "mozilla org ", 1, 0.95, "mozilla org mpl 2 0"),
    ("mpl-2.0", "source code ", 1, 0.95, "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-1.1", "contents of ", 2, 0.7, "the contents of this file are subject to the mozilla public licen[sc]e"),
    ("epl-2.0", "eclipse org ", 1, 0.9, "eclipse org (?:legal )?epl (?:v20|2 0)"),
    ("epl-1.0", "eclipse org ", 1, 0.9, "eclipse org (?:legal )?epl v10"),
    ("edl", "eclipse distribution ", 2, 0.8, "eclipse distribution licen[sc]e"),
    ("cpl-1.0", "common public ", 2, 0.8, "common public licen[sc]e"),
    ("ipl-1.0", "ibm public ", 2, 0.8, "ibm public licen[sc]e"),
    ("cddl", "cddl ", 2, 0.6, "cddl(?: version)? 1 [01]"),
    ("npl", "netscape public ", 2, 0.8, "netscape public licen[sc]e"),
    ("apsl", "apple public ", 2, 0.8, "apple public source licen[sc]e"),
    ("qpl", "q public |qpl ", 2, 0.7, "(?:q public licen[sc]e|qpl 1 0)"),
    ("sleepycat", "sleepycat ", 2, 0.7, "sleepycat licen[sc]e"),
    ("eupl", "eupl", 1, 0.85, "eupl(?: v| version)? ?1 [012]"),
    ("cecill", "cecill ", 2, 0.8, "cecill(?: [bc])?(?: licen[sc]e)?(?: v?[12] [01])?"),
    ("mulan", "mulan ", 2, 0.8, "mulan (?:psl|permissive software licen[sc]e)(?: v[12])?"),
    ("bsl-1.1", "business source ", 1, 0.85, "business source licen[sc]e(?: 1 1)?"),
    ("sspl", "server side ", 1, 0.9, "server side public licen[sc]e"),
    ("elastic-2.0", "elastic ", 2, 0.8, "elastic licen[sc]e(?: v?2(?: 0)?)?"),
    ("commons-clause", "commons clause ", 1, 0.85, "commons clause(?: licen[sc]e condition)?"),
    ("polyform", "polyform ", 2, 0.8, "polyform (?:noncommercial|small business|strict|shield) licen[sc]e"),
    ("parity", "parity public ", 2, 0.7, "parity public licen[sc]e"),
    ("ogl", "open government |open game ", 2, 0.8, "open (?:government|game) licen[sc]e(?: v?[123](?: 0)?)?"),
    ("openrail", "rail |openrail ", 2, 0.8, "(?:creativeml )?open ?rail (?:m )?licen[sc]e"),
    ("llama", "llama ", 2, 0.7, "llama [23](?: [123])? community licen[sc]e"),
    # the gnu family
    ("gpl", "free software ", 1, 0.9, "this program is free software you can redistribute it and or modify it"),
    ("gpl", "free software ", 2, 0.7, "as published by the free software foundation"),
    ("gpl", "free software ", 3, 0.4, "free software foundation(?: inc)?"),
    ("gpl", "at your ", 2, 0.6, "version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0", "at your ", 2, 0.75, "version 3 of the licen[sc]e or at your option any later version"),
    ("gpl", "gnu org ", 2, 0.7, "gnu org (?:copyleft|licenses)(?: gpl)?"),
    ("gpl", "copy of ", 2, 0.8, "you should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", "copy of ", 1, 0.85, "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", "copy of ", 1, 0.9, "you should have received a copy of the gnu affero general public licen[sc]e"),
    ("gpl", "gplv2 |gplv3 |gpl2 |gpl3 ", 2, 0.85, "gplv?[23](?: or later)?"),
    ("lgpl", "lgplv2 |lgplv3 |lgpl2 |lgpl3 ", 2, 0.85, "lgplv?[23](?: 1)?(?: or later)?"),
    ("agpl-3.0", "agplv3 |agpl3 ", 1, 0.9, "agplv?3(?: or later)?"),
    ("gpl-classpath", "classpath ", 1, 0.85, "(?:gpl )?(?:with )?(?:the )?classpath exception"),
    ("gpl-gcc", "runtime library ", 1, 0.85, "gcc runtime library exception"),
    ("gpl-linking", "linking |special ", 2, 0.6, "(?:special|linking) exception"),
    ("gfdl", "permission is ", 1, 0.9, "permission is granted to copy distribute and or modify this document"),
    ("gfdl", "invariant sections ", 2, 0.7, "(?:with )?no invariant sections"),
    ("gpl", "copyleft ", 3, 0.5, "copyleft(?: licen[sc]e)?"),
    # creative commons and data
    ("cc", "creativecommons org ", 2, 0.8, "creativecommons org"),
    ("cc-by", "creativecommons org ", 1, 0.95, "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org ", 1, 0.95, "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons org ", 1, 0.95, "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons org ", 1, 0.95, "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org ", 1, 0.95, "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org ", 1, 0.95, "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0", "creativecommons org ", 1, 0.95, "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org ", 1, 0.9, "creativecommons org publicdomain mark 1 0"),
    ("cc-by", "attribution ", 2, 0.6, "attribution [1-4] [05] (?:international|unported|generic)"),
    ("cc-by-sa", "attribution ", 2, 0.7, "attribution share ?alike [1-4] [05]"),
    ("cc-by-nc", "attribution ", 2, 0.7, "attribution non ?commercial [1-4] [05]"),
    ("cc", "cc licen", 3, 0.5, "cc licen[sc]ed?"),
    ("cc-by-nc-sa", "by nc ", 3, 0.5, "by nc sa [1-4] 0"),
    ("cc0", "waived all ", 1, 0.9, "(?:has )?waived all copyright and related"),
    ("cdla", "community data ", 2, 0.8, "community data licen[sc]e agreement(?: (?:permissive|sharing))?"),
    ("odc-by", "opendatacommons org ", 1, 0.9, "opendatacommons org licenses by"),
    ("odbl", "opendatacommons org ", 1, 0.9, "opendatacommons org licenses odbl"),
    ("pddl", "opendatacommons org ", 1, 0.9, "opendatacommons org licenses pddl"),
    ("ofl-1.1", "sil ofl |scripts sil ", 1, 0.85, "(?:sil ofl 1 1|scripts sil org ofl)"),
    ("ofl-1.1", "reserved font ", 2, 0.7, "with reserved font name"),
    # public domain
    ("public-domain", "public domain ", 2, 0.8, "(?:dedicated to|released into|placed in|in) the public domain"),
    ("public-domain", "no rights ", 2, 0.7, "no rights reserved"),
    ("public-domain", "public domain ", 3, 0.5, "public domain"),
    ("public-domain", "no copyright ", 3, 0.4, "no copyright(?: is claimed)?"),
    ("public-domain", "government work ", 2, 0.7, "(?:us |united states )?government work"),
    # copyright lines and reservations
    ("reserved", "all rights ", 1, 0.95, "copyright (?:c )?[0-9]{4}(?: [0-9]{4})?(?: by)?(?: [^ ]+){0,4}? all rights reserved"),
    ("reserved", "all rights ", 2, 0.8, "all rights (?:are )?reserved"),
    ("some-reserved", "some rights ", 2, 0.6, "some rights reserved"),
    ("reserved", "tous droits ", 2, 0.8, "tous droits r\u00e9serv\u00e9s"),
    ("reserved", "alle rechte ", 2, 0.8, "alle rechte vorbehalten"),
    ("reserved", "todos los ", 2, 0.8, "todos los derechos reservados"),
    ("copyright", "copyright |copr ", 2, 0.6, "(?:copyright|copr) (?:c )?[0-9]{4}(?: [0-9]{4})?"),
    ("copyright", "copyright ", 3, 0.4, "(?:protected by|under) copyright"),
    ("copyright", "copyright ", 3, 0.3, "copyright"),
    ("copyright", "copyrighted ", 3, 0.4, "copyrighted (?:material|work|by)"),
    ("copyright", "spdx filecopyrighttext ", 1, 0.8, "spdx filecopyrighttext"),
    ("copyright", "international copyright ", 3, 0.4, "international copyright (?:laws?|treaties)"),
    # proprietary terms
    ("proprietary", "proprietary ", 1, 0.9, "proprietary and confidential"),
    ("proprietary", "confidential ", 2, 0.6, "confidential (?:and )?proprietary"),
    ("proprietary", "trade secret", 2, 0.6, "trade secrets? (?:of|and)"),
    ("proprietary", "do not |may not |not for ", 2, 0.6, "(?:do not|may not be|not for) (?:copy|copied|redistribute|redistribution|redistributed)"),
    ("proprietary", "unauthori", 2, 0.7, "unauthori[sz]ed (?:copying|use|reproduction|distribution)"),
    ("proprietary", "reverse engineer", 2, 0.7, "(?:not )?reverse engineer(?:ing)?"),
    ("proprietary", "strictly prohibited ", 2, 0.6, "(?:reproduction|copying|distribution|redistribution) is strictly prohibited"),
    ("proprietary", "commercial license ", 2, 0.6, "(?:requires a )?commercial license"),
    ("eula", "end user ", 1, 0.8, "end user licen[sc]e agreement"),
    ("eula", "eula ", 2, 0.6, "eula"),
    ("eula", "software license ", 2, 0.5, "software license agreement"),
    ("terms", "terms of ", 3, 0.4, "terms of (?:use|service)"),
    ("terms", "accept the ", 3, 0.4, "you (?:must )?accept the terms"),
    ("shareware", "shareware ", 2, 0.6, "shareware"),
    ("freeware", "freeware ", 2, 0.6, "freeware"),
    ("trial", "evaluation ", 2, 0.5, "(?:for )?evaluation purposes only"),
    ("non-commercial", "non commercial |noncommercial ", 2, 0.6, "(?:for )?non ?commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", "personal ", 2, 0.5, "(?:for )?personal (?:and )?(?:non ?commercial )?use only"),
    ("non-commercial", "research purposes ", 2, 0.5, "(?:for )?research purposes only"),
    ("educational", "educational ", 2, 0.5, "(?:for )?educational (?:use|purposes) only"),
    ("permission-required", "written permission ", 2, 0.5, "(?:with|without) (?:the )?(?:prior )?(?:express )?written permission"),
    ("permission-required", "prior consent |written consent ", 2, 0.5, "(?:prior|written) consent of the (?:author|publisher|owner)"),
    ("reprint", "with permission |by permission ", 2, 0.5, "(?:reprinted|reproduced|used) (?:with|by) permission"),
    # warranty and mentions
    ("warranty-disclaimer", "warrant", 3, 0.3, "without (?:any )?warrant(?:y|ies)(?: or conditions)?(?: of any kind)?"),
    ("warranty-disclaimer", "provided as ", 3, 0.3, "provided as is"),
    ("warranty-disclaimer", "merchantability ", 3, 0.4, "(?:implied )?warrant(?:y|ies) of merchantability"),
    ("warranty-disclaimer", "fitness for ", 3, 0.4, "fitness for a particular purpose"),
    ("warranty-disclaimer", "in no ", 3, 0.3, "in no event shall"),
    ("license-mention", "licen", 3, 0.3, "licen[sc]e agreement"),
    ("license-mention", "see the ", 3, 0.3, "see the (?:accompanying )?licen[sc]e(?: file)?"),
    ("license-mention", "license file |license txt |license md ", 3, 0.3, "license (?:file|txt|md)"),
    ("open-source", "open source ", 3, 0.3, "open source (?:software|licen[sc]e)"),
    ("osi", "opensource org ", 2, 0.4, "opensource org licenses"),
    ("spdx", "spdx ", 3, 0.4, "spdx licen[sc]e identifier"),
]


@functools.cache
def rules() -> tuple[tuple[str, str, tuple[str, ...], int, float, bool], ...]:
    """(label, expression, groups of keywords, priority, confidence, base) in order. A match holds one keyword of each group."""
    made = [(label, phrase, (f"{phrase} ",), 2, 0.7, True) for phrase, label in BASE]
    for form, word, priority, confidence in FORMS:
        made += [(label, form.replace("{name}", name), (own, word) if word else (own,), priority, confidence, False) for label, name, own, alone in NAMES if alone or form != "{name}"]
    made += [(label, regex, (word,), priority, confidence, False) for label, word, priority, confidence, regex in SIGNATURES]
    return tuple((label, f"(?<= ){regex}(?= )", words, priority, confidence, base) for label, regex, words, priority, confidence, base in made)


def keywords() -> list[str]:
    return sorted({w for r in rules() for group in r[2] for w in group.split("|")})


def _sql(x: object) -> str:
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{x}D" if isinstance(x, float) else str(x).lower()


def normal(text: Column) -> Column:
    """The words joined by single blanks, not lower-cased."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS, " "))


def _listed(words: list[str]) -> str:
    return f"array({', '.join(_sql(w) for w in words)})"


def _places(s: str, no: int, regex: str) -> str:
    """(first, back, priority, no, last) of a rule's matches: where words of the string begin and end a marked match. back is the last word, less than 0."""
    priority = rules()[no][3]
    marks = f"split(regexp_replace({s}, {_sql(regex + '')}, '\u0001$0\u0002'), ' ')"
    ends = lambda test: f"filter(transform(w, (x, i) -> IF({test}, i - 1, -1)), i -> i >= 0)"
    first, last = ends("startswith(x, '\u0001')"), ends("endswith(x, '\u0002')")
    row = f"(a, b) -> named_struct('first', a, 'back', -b, 'priority', {priority}, 'no', {no})"
    return f"IF({s} RLIKE {_sql(regex)}, transform(array({marks}), w -> zip_with({first}, {last}, {row}))[0], cast(array() AS {KIND}))"


KIND = "array<struct<first:int,back:int,priority:int,no:int>>"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words and detections: an array of (first, last, label, priority, confidence, base, stays), first and last being word numbers from 0."""
    n_, s_, k_, f_ = (unused(docs, x) for x in ("words", "line", "held", "found"))
    none = f"cast(array() AS {KIND})"
    # Rules by their first group of keywords, and then by their second.
    groups: dict[str, dict[str, list[int]]] = {}
    for no, r in enumerate(rules()):
        groups.setdefault(r[2][0], {}).setdefault("".join(r[2][1:]), []).append(no)
    held = lambda words: f"arrays_overlap({k_}, {_listed(words.split('|'))})"
    parts = []
    for own, forms in groups.items():
        inner = []
        for word, numbers in forms.items():
            each = f"concat({', '.join(_places(s_, no, rules()[no][1]) for no in numbers)})"
            inner.append(f"IF({held(word)}, {each}, {none})" if word else each)
        parts.append(f"IF({held(own)}, concat({', '.join(inner)}), {none})")
    found = f"array_sort(concat({', '.join(parts)}))"

    facts = "array(" + ", ".join(f"named_struct('label', {_sql(r[0])}, 'confidence', {_sql(r[4])}, 'base', {_sql(r[5])})" for r in rules()) + ")"
    out = "array<struct<first:bigint,last:bigint,label:string,priority:int,confidence:double,base:boolean,stays:boolean>>"
    reach = "CASE x.priority WHEN 1 THEN acc.m1 WHEN 2 THEN greatest(acc.m1, acc.m2) ELSE greatest(acc.m1, acc.m2, acc.m3) END"
    best = lambda k: f"IF(x.priority = {k}, greatest(acc.m{k}, -x.back), acc.m{k})"
    fact = f"element_at({facts}, x.no + 1)"
    one = f"transform(array({fact}), f -> named_struct('first', bigint(x.first), 'last', bigint(-x.back), 'label', f.label, 'priority', x.priority, 'confidence', f.confidence, 'base', f.base, 'stays', -x.back > {reach}))"
    start = "named_struct('m1', {0}m1, 'm2', {0}m2, 'm3', {0}m3, 'out', {1})"
    # From left to right, with the farthest word that each priority has covered; a part's rows are added to the whole at once.
    inner = f"""aggregate(slice({f_}, p * {PART} + 1, {PART}), {start.format('all.', f'cast(array() AS {out})')},
        (acc, x) -> named_struct('m1', {best(1)}, 'm2', {best(2)}, 'm3', {best(3)}, 'out', concat(acc.out, {one})),
        acc -> named_struct('m1', acc.m1, 'm2', acc.m2, 'm3', acc.m3, 'out', concat(all.out, acc.out)))"""
    resolved = f"""aggregate(sequence(0, (size({f_}) - 1) div {PART}), named_struct('m1', -1, 'm2', -1, 'm3', -1, 'out', cast(array() AS {out})),
        (all, p) -> {inner}, all -> all.out)"""

    rows = docs.withColumn(n_, normal(F.col(text_col)))
    rows = rows.withColumn(s_, F.lower(F.concat(F.lit(" "), F.col(n_), F.lit(" "))))
    rows = rows.withColumn(k_, F.expr(f"filter({_listed(keywords())}, k -> contains({s_}, concat(' ', k)))"))
    rows = rows.withColumn(f_, F.expr(f"IF(size({k_}) > 0, {found}, {none})"))
    rows = rows.withColumn("detections", F.expr(f"IF(size({f_}) > 0, {resolved}, cast(array() AS {out}))"))
    n = F.when(F.col(n_) == "", F.lit(0)).otherwise(F.length(n_) - F.length(F.replace(F.col(n_), F.lit(" "), F.lit(""))) + 1)
    return rows.withColumn("n_words", n.cast("long")).drop(n_, s_, k_, f_)


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row; the score is the best confidence of a detection that stays."""
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = "filter(detections, x -> x.base)"
    return rows.select(
        "doc_id",
        "n_words",
        F.expr(f"cast(size({base}) AS bigint)").alias("n_base"),
        F.expr(f"array_min(transform({base}, x -> x.first))").alias("first_word"),
        F.expr(f"array_max(transform({base}, x -> x.first))").alias("last_word"),
        F.expr(f"array_join(array_sort(array_distinct(transform({base}, x -> x.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(filter(detections, x -> x.base OR x.stays), x -> x.label))), ',')").alias("labels"),
        F.expr("coalesce(array_max(transform(filter(detections, x -> x.stays), x -> x.confidence)), 0D)").alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict[str, str] = {}
