"""License scans: ordered signature rules over whole texts.

Every rule is a regular expression with a label and a priority: sentences of
the license texts, written by hand, and for each license the ways in which
people name it. Keywords come from the patterns: a set of literals of which
every match holds at least one. An automaton finds all keywords in one pass
over a text; only rules of which every set occurs are searched, so the
prefilter can't hide a match. What the rules detect is
then resolved in order of priority: a detection that lies inside the interval
of one accepted before it is suppressed, so that ``apache license, version
2.0`` isn't reported again as ``apache license``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from re import _parser as parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from motorspark.llm._io import documents, small_batches

#: Words in lower-cased UTF-8 are runs of these bytes.
WORD, GAP = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_PATTERNS = [
    (label, re.compile(rb"(?<!" + WORD + rb")" + (GAP + b"+").join(phrase.encode().split()) + rb"(?!" + WORD + rb")"))
    for phrase, label in BASE.items()
]

#: Priorities, in the order in which detections are accepted, with the weight of one detection.
TEXT, TAG, NOTICE, URL, NAME, HINT = range(6)
WEIGHT = {TEXT: 0.98, TAG: 0.98, NOTICE: 0.95, URL: 0.9, NAME: 0.8, HINT: 0.4}

V = r"(?:,?\s*v(?:ersion)?\.?\s*|\s*-\s*|\s+)"
UNDER = r"(?:licen[sc]ed|released|distributed|available|provided|published|covered|made available|redistributed)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?"
THE = r"(?:the\s+)?"

# Label, name as people write it (regular expression), SPDX tag, address. A dash stands for none.
FAMILIES = """
mit | mit(?:\\s*/\\s*x11|/expat)?\\s+licen[sc]e | mit | opensource\\.org/licenses/mit\\b
mit-0 | mit\\s+no\\s+attribution | mit-0 | opensource\\.org/licenses/mit-0
x11 | x11\\s+licen[sc]e | x11 | -
isc | isc\\s+licen[sc]e | isc | opensource\\.org/licenses/isc
apache-1.0 | apache\\s+(?:software\\s+)?licen[sc]e{V}1\\.0 | apache-1\\.0 | apache\\.org/licenses/license-1\\.0
apache-1.1 | apache\\s+(?:software\\s+)?licen[sc]e{V}1\\.1 | apache-1\\.1 | apache\\.org/licenses/license-1\\.1
apache-2.0 | apache\\s+(?:software\\s+)?licen[sc]e(?:\\s*\\(asl\\))?{V}2(?:\\.0)? | apache-2\\.0 | apache\\.org/licenses/license-2\\.0
bsd-2-clause | (?:simplified|2-clause|two-clause|freebsd)\\s+(?:bsd\\s+)?licen[sc]e | bsd-2-clause | opensource\\.org/licenses/bsd-2-clause
bsd-3-clause | (?:new|modified|revised|3-clause|three-clause)\\s+bsd\\s+licen[sc]e | bsd-3-clause | opensource\\.org/licenses/bsd-3-clause
bsd-4-clause | (?:original|old|4-clause|four-clause)\\s+bsd\\s+licen[sc]e | bsd-4-clause | -
0bsd | (?:zero-clause|0-clause)\\s+bsd\\s+licen[sc]e | 0bsd | opensource\\.org/licenses/0bsd
gpl-1.0 | (?:gnu\\s+)?general\\s+public\\s+licen[sc]e{V}1(?:\\.0)? | gpl-1\\.0(?:-only|-or-later|\\+)? | gnu\\.org/licenses/(?:old-licenses/)?gpl-1\\.0
gpl-2.0 | (?:gnu\\s+)?general\\s+public\\s+licen[sc]e{V}2(?:\\.0)? | gpl-2\\.0(?:-only|-or-later|\\+)? | gnu\\.org/licenses/(?:old-licenses/)?gpl-2\\.0
gpl-3.0 | (?:gnu\\s+)?general\\s+public\\s+licen[sc]e{V}3(?:\\.0)? | gpl-3\\.0(?:-only|-or-later|\\+)? | gnu\\.org/licenses/gpl-3\\.0
lgpl-2.0 | (?:gnu\\s+)?library\\s+general\\s+public\\s+licen[sc]e(?:{V}2(?:\\.0)?)? | lgpl-2\\.0(?:-only|-or-later|\\+)? | gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.0
lgpl-2.1 | (?:gnu\\s+)?lesser\\s+general\\s+public\\s+licen[sc]e{V}2\\.1 | lgpl-2\\.1(?:-only|-or-later|\\+)? | gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.1
lgpl-3.0 | (?:gnu\\s+)?lesser\\s+general\\s+public\\s+licen[sc]e{V}3(?:\\.0)? | lgpl-3\\.0(?:-only|-or-later|\\+)? | gnu\\.org/licenses/lgpl-3\\.0
agpl-3.0 | (?:gnu\\s+)?affero\\s+general\\s+public\\s+licen[sc]e(?:{V}3(?:\\.0)?)? | agpl-3\\.0(?:-only|-or-later|\\+)? | gnu\\.org/licenses/agpl-3\\.0
gfdl | (?:gnu\\s+)?free\\s+documentation\\s+licen[sc]e(?:{V}1\\.[123])? | gfdl-1\\.[123](?:-only|-or-later)? | gnu\\.org/licenses/fdl
mpl-1.0 | mozilla\\s+public\\s+licen[sc]e{V}1\\.0 | mpl-1\\.0 | mozilla\\.org/mpl/1\\.0
mpl-1.1 | mozilla\\s+public\\s+licen[sc]e{V}1\\.1 | mpl-1\\.1 | mozilla\\.org/mpl/1\\.1
mpl-2.0 | mozilla\\s+public\\s+licen[sc]e{V}2(?:\\.0)? | mpl-2\\.0 | mozilla\\.org/(?:en-us/)?mpl/2\\.0
epl-1.0 | eclipse\\s+public\\s+licen[sc]e{V}1(?:\\.0)? | epl-1\\.0 | eclipse\\.org/legal/epl-v10
epl-2.0 | eclipse\\s+public\\s+licen[sc]e{V}2(?:\\.0)? | epl-2\\.0 | eclipse\\.org/legal/epl-(?:v20|2\\.0)
cddl-1.0 | common\\s+development\\s+and\\s+distribution\\s+licen[sc]e{V}1\\.0 | cddl-1\\.0 | opensource\\.org/licenses/cddl-1
cddl-1.1 | common\\s+development\\s+and\\s+distribution\\s+licen[sc]e{V}1\\.1 | cddl-1\\.1 | -
cpl-1.0 | common\\s+public\\s+licen[sc]e(?:{V}1\\.0)? | cpl-1\\.0 | opensource\\.org/licenses/cpl1
eupl-1.2 | european\\s+union\\s+public\\s+licen[sc]e(?:{V}1\\.[012])? | eupl-1\\.[012] | joinup\\.ec\\.europa\\.eu/\\S*eupl
artistic-1.0 | artistic\\s+licen[sc]e{V}1(?:\\.0)? | artistic-1\\.0(?:-perl)? | -
artistic-2.0 | artistic\\s+licen[sc]e{V}2(?:\\.0)? | artistic-2\\.0 | opensource\\.org/licenses/artistic-2
bsl-1.0 | boost\\s+software\\s+licen[sc]e(?:{V}1\\.0)? | bsl-1\\.0 | boost\\.org/license_1_0
busl-1.1 | business\\s+source\\s+licen[sc]e(?:{V}1\\.1)? | busl-1\\.1 | mariadb\\.com/bsl11
sspl-1.0 | server\\s+side\\s+public\\s+licen[sc]e(?:{V}1)? | sspl-1\\.0 | mongodb\\.com/licensing/server-side
elastic-2.0 | elastic\\s+licen[sc]e(?:{V}2(?:\\.0)?)? | elastic-2\\.0 | elastic\\.co/licensing/elastic-license
zlib | zlib(?:/libpng)?\\s+licen[sc]e | zlib | opensource\\.org/licenses/zlib
libpng | libpng\\s+licen[sc]e | libpng(?:-2\\.0)? | libpng\\.org/\\S*license
openssl | openssl\\s+licen[sc]e | openssl | openssl\\.org/source/license
python-2.0 | python\\s+software\\s+foundation\\s+licen[sc]e(?:{V}2)? | (?:python|psf)-2\\.0 | docs\\.python\\.org/\\d/license
php-3.01 | php\\s+licen[sc]e(?:{V}3\\.0?1?)? | php-3\\.01? | php\\.net/license
ruby | ruby\\s+licen[sc]e | ruby | ruby-lang\\.org/\\S*license
w3c | w3c\\s+software\\s+(?:notice\\s+and\\s+)?licen[sc]e | w3c | w3\\.org/consortium/legal/\\S*software
unlicense | the\\s+unlicen[sc]e | unlicense | unlicense\\.org
wtfpl | do\\s+what\\s+the\\s+f\\S+\\s+you\\s+want\\s+to\\s+public\\s+licen[sc]e|wtfpl | wtfpl | wtfpl\\.net
beerware | beer-?ware\\s+licen[sc]e | beerware | -
postgresql | postgresql\\s+licen[sc]e | postgresql | opensource\\.org/licenses/postgresql
ncsa | (?:university\\s+of\\s+illinois/)?ncsa\\s+open\\s+source\\s+licen[sc]e | ncsa | opensource\\.org/licenses/ncsa
ofl-1.1 | (?:sil\\s+)?open\\s+font\\s+licen[sc]e(?:{V}1\\.1)? | ofl-1\\.1 | scripts\\.sil\\.org/ofl
upl-1.0 | universal\\s+permissive\\s+licen[sc]e(?:{V}1\\.0)? | upl-1\\.0 | oss\\.oracle\\.com/licenses/upl
ms-pl | microsoft\\s+public\\s+licen[sc]e | ms-pl | opensource\\.org/licenses/ms-pl
ms-rl | microsoft\\s+reciprocal\\s+licen[sc]e | ms-rl | opensource\\.org/licenses/ms-rl
osl-3.0 | open\\s+software\\s+licen[sc]e(?:{V}3(?:\\.0)?)? | osl-3\\.0 | opensource\\.org/licenses/osl-3
afl-3.0 | academic\\s+free\\s+licen[sc]e(?:{V}3(?:\\.0)?)? | afl-3\\.0 | opensource\\.org/licenses/afl-3
ecl-2.0 | educational\\s+community\\s+licen[sc]e(?:{V}2(?:\\.0)?)? | ecl-2\\.0 | opensource\\.org/licenses/ecl-2
cecill-2.1 | cecill(?:{V}2\\.[01])?\\s+licen[sc]e | cecill-2\\.[01] | cecill\\.info
mulan-psl-2.0 | mulan\\s+permissive\\s+software\\s+licen[sc]e(?:{V}2)? | mulanpsl-2\\.0 | license\\.coscl\\.org\\.cn
lppl-1.3 | latex\\s+project\\s+public\\s+licen[sc]e(?:{V}1\\.3[ac]?)? | lppl-1\\.3[ac] | latex-project\\.org/lppl
odbl-1.0 | open\\s+database\\s+licen[sc]e(?:{V}1\\.0)? | odbl-1\\.0 | opendatacommons\\.org/licenses/odbl
odc-by-1.0 | open\\s+data\\s+commons\\s+attribution\\s+licen[sc]e(?:{V}1\\.0)? | odc-by-1\\.0 | opendatacommons\\.org/licenses/by
pddl-1.0 | (?:open\\s+data\\s+commons\\s+)?public\\s+domain\\s+dedication\\s+and\\s+licen[sc]e | pddl-1\\.0 | opendatacommons\\.org/licenses/pddl
cdla-permissive-2.0 | community\\s+data\\s+licen[sc]e\\s+agreement\\W+permissive | cdla-permissive-[12]\\.0 | cdla\\.(?:io|dev)/permissive
cc0-1.0 | cc0(?:{V}1\\.0)?(?:\\s+universal)? | cc0-1\\.0 | creativecommons\\.org/publicdomain/zero
cc-by-nc-nd | cc[\\s-]by-nc-nd(?:[\\s-]+[1-4]\\.[05])? | cc-by-nc-nd-[1-4]\\.[05] | creativecommons\\.org/licenses/by-nc-nd
cc-by-nc-sa | cc[\\s-]by-nc-sa(?:[\\s-]+[1-4]\\.[05])? | cc-by-nc-sa-[1-4]\\.[05] | creativecommons\\.org/licenses/by-nc-sa
cc-by-nc | cc[\\s-]by-nc(?![\\s-]*(?:nd|sa))(?:[\\s-]+[1-4]\\.[05])? | cc-by-nc-[1-4]\\.[05] | creativecommons\\.org/licenses/by-nc/
cc-by-nd | cc[\\s-]by-nd(?:[\\s-]+[1-4]\\.[05])? | cc-by-nd-[1-4]\\.[05] | creativecommons\\.org/licenses/by-nd
cc-by-sa | cc[\\s-]by-sa(?:[\\s-]+[1-4]\\.[05])? | cc-by-sa-[1-4]\\.[05] | creativecommons\\.org/licenses/by-sa
cc-by | cc[\\s-]by(?![\\s-]*(?:nc|nd|sa))(?:[\\s-]+[1-4]\\.[05]|\\s+licen[sc]e)|cc-by(?![\\w-]) | cc-by-[1-4]\\.[05] | creativecommons\\.org/licenses/by/
openrail | (?:creativeml\\s+|bigscience\\s+)?open\\s*rail(?:\\+\\+)?(?:-m)?\\s+licen[sc]e | (?:creativeml-|bigscience-)?openrail(?:-m)? | -
""".strip().splitlines()

# Short names that stand for a license only after words like "licensed under" or "license:". Label, name.
SHORT = """
mit | mit(?!\\s+press)
isc | isc
zlib | zlib
apache-2.0 | apache(?:{V}|\\s*)2(?:\\.0)?
apache | apache
bsd-2-clause | (?:2|two)[\\s-]clause\\s+bsd|bsd[\\s-]2(?:[\\s-]clause)?
bsd-3-clause | (?:3|three)[\\s-]clause\\s+bsd|bsd[\\s-]3(?:[\\s-]clause)?
bsd | bsd
gpl-2.0 | (?:gnu\\s+)?gpl(?:{V}|\\s*)2(?:\\.0)?
gpl-3.0 | (?:gnu\\s+)?gpl(?:{V}|\\s*)3(?:\\.0)?
lgpl-2.1 | (?:gnu\\s+)?lgpl(?:{V}|\\s*)2\\.1
lgpl-3.0 | (?:gnu\\s+)?lgpl(?:{V}|\\s*)3(?:\\.0)?
agpl-3.0 | (?:gnu\\s+)?agpl(?:(?:{V}|\\s*)3(?:\\.0)?)?
mpl-2.0 | mpl(?:{V}|\\s*)2(?:\\.0)?
mpl-1.1 | mpl(?:{V}|\\s*)1\\.1
epl-2.0 | epl(?:{V}|\\s*)2(?:\\.0)?
epl-1.0 | epl(?:{V}|\\s*)1(?:\\.0)?
eupl-1.2 | eupl(?:(?:{V}|\\s*)1\\.[012])?
cddl | cddl
bsl-1.0 | boost(?:{V}1\\.0)?
ofl-1.1 | ofl(?:{V}1\\.1)?
artistic-2.0 | artistic{V}2(?:\\.0)?
unlicense | unlicen[sc]e
wtfpl | wtfpl
cc0-1.0 | cc0|creative\\s+commons\\s+zero
cc-by-nc-nd | creative\\s+commons\\s+by-nc-nd
cc-by-nc-sa | creative\\s+commons\\s+by-nc-sa
cc-by-nc | creative\\s+commons\\s+by-nc(?!-)
cc-by-sa | creative\\s+commons\\s+by-sa
cc-by-nd | creative\\s+commons\\s+by-nd
cc-by | creative\\s+commons\\s+by(?!-)
""".strip().splitlines()

# Sentences from the texts of the licenses, and phrases that only hint at one. Label, priority, the words (a space stands for white space), in lower case.
SENTENCES = [
    ("mit", TEXT, r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", TEXT, r"to deal in the software without restriction, including without limitation the rights to use, copy, modify"),
    ("mit", TEXT, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", TEXT, r"the software is provided \W{0,2}as is\W{0,2}, without warranty of any kind, express or implied"),
    ("x11", TEXT, r"except as contained in this notice, the names? of [\s\S]{1,120}? shall not be used in advertising"),
    ("mit-cmu", TEXT, r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("mit-advertising", TEXT, r"the name of [\s\S]{1,80}? not be used in advertising or publicity pertaining to distribution of the software"),
    ("isc", TEXT, r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", TEXT, r"the author disclaims all warranties with regard to this software"),
    ("apache-2.0", TEXT, r"you may not use this file except in compliance with the license"),
    ("apache-2.0", TEXT, r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an"),
    ("apache-2.0", TEXT, r"contributor license agreements\. see the notice file distributed with this work for additional information"),
    ("apache-2.0", TEXT, r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("apache-1.1", TEXT, r"this product includes software developed by the apache (?:software foundation|group)"),
    ("bsd", TEXT, r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd", TEXT, r"redistributions of source code must retain the above copyright notice, this list of conditions"),
    ("bsd", TEXT, r"redistributions in binary form must reproduce the above copyright notice, this list of conditions"),
    ("bsd", TEXT, r"this software is provided by the (?:copyright holders?(?: and contributors)?|regents and contributors|author)[\s\S]{0,80}?\W{0,2}as is\W"),
    ("bsd-3-clause", TEXT, r"neither the names? of [\s\S]{1,120}? may be used to endorse or promote"),
    ("bsd-3-clause", TEXT, r"the names? of [\s\S]{1,80}? may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", TEXT, r"all advertising materials mentioning features or use of this software"),
    ("gpl", TEXT, r"redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", TEXT, r"either version [123] of the license, or \(?at your option\)? any later version"),
    ("gpl", TEXT, r"you should have received a copy of the gnu general public license along with"),
    ("gpl", TEXT, r"the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
    ("gpl-3.0", TEXT, r"the gnu general public license does not permit incorporating your program into proprietary programs"),
    ("gpl-2.0", TEXT, r"this general public license does not permit incorporating your program into proprietary programs"),
    ("gpl-3.0", TEXT, r"to protect your rights, we need to prevent others from denying you these rights or asking you to surrender the rights"),
    ("gpl-2.0", TEXT, r"to protect your rights, we need to make restrictions that forbid anyone to deny you these rights"),
    ("lgpl", TEXT, r"under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("lgpl", TEXT, r"you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl-2.1", TEXT, r"this license, the lesser general public license, applies to some specially designated software packages"),
    ("lgpl-3.0", TEXT, r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3.0", TEXT, r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl-3.0", TEXT, r"all users interacting with it remotely through a computer network"),
    ("agpl-3.0", TEXT, r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gfdl", TEXT, r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", TEXT, r"with no invariant sections, no front-cover texts,? and no back-cover texts"),
    ("mpl-2.0", TEXT, r"this source code form is subject to the terms of the mozilla public license, v\. ?2\.0"),
    ("mpl-2.0", TEXT, r"if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("mpl-1.1", TEXT, r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-1.0", TEXT, r"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("mpl", TEXT, r"software distributed under the license is distributed on an \W{0,2}as is\W{0,2} basis, without warranty of any kind, either express(?:ed)? or implied\. see the license for the specific language"),
    ("npl-1.1", TEXT, r"the contents of this file are subject to the netscape public license"),
    ("epl-2.0", TEXT, r"this program and the accompanying materials are made available under the terms of the eclipse public license,? (?:v\.? ?|version )2\.0"),
    ("epl-1.0", TEXT, r"this program and the accompanying materials are made available under the terms of the eclipse public license,? (?:v\.? ?|version )1\.0"),
    ("epl", TEXT, r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1.0", TEXT, r"the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", TEXT, r"the accompanying program is provided under the terms of this ibm public license"),
    ("cddl", TEXT, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", TEXT, r"when distributing covered code, include this cddl header notice in each file"),
    ("eupl-1.2", TEXT, r"licensed under the eupl, version 1\.[012] or - as soon they will be approved"),
    ("eupl-1.2", TEXT, r"this european union public licence \(the \W{0,2}eupl\W{0,2}\) applies to the work"),
    ("artistic-2.0", TEXT, r"this license establishes the terms under which a given free software package may be copied, modified, distributed"),
    ("artistic-1.0", TEXT, r"the intent of this document is to state the conditions under which a package may be copied"),
    ("perl", TEXT, r"redistribute it and/or modify it under the same terms as perl itself"),
    ("bsl-1.0", TEXT, r"distributed under the boost software license, version 1\.0"),
    ("bsl-1.0", TEXT, r"to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works"),
    ("busl-1.1", TEXT, r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use"),
    ("sspl-1.0", TEXT, r"under the terms of the server side public license, version 1, as published by mongodb"),
    ("elastic-2.0", TEXT, r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", TEXT, r"the grant of rights under the license will not include, and the license does not grant to you, the right to sell the software"),
    ("unlicense", TEXT, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", TEXT, r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", TEXT, r"this software is provided 'as-is', without any express or implied warranty"),
    ("zlib", TEXT, r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib", TEXT, r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original"),
    ("libpng", TEXT, r"the png reference library is supplied \W{0,2}as is"),
    ("ijg", TEXT, r"this software is based in part on the work of the independent jpeg group"),
    ("openssl", TEXT, r"this product includes software developed by the openssl project"),
    ("openssl", TEXT, r"the names \W{0,2}openssl toolkit\W{0,2} and \W{0,2}openssl project\W{0,2} must not be used"),
    ("curl", TEXT, r"except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale"),
    ("python-2.0", TEXT, r"this license agreement is between the python software foundation \(\W{0,2}psf\W{0,2}\)"),
    ("php-3.01", TEXT, r"this product includes php software, freely available from"),
    ("php-3.01", TEXT, r"this source file is subject to version 3\.0?1? of the php license"),
    ("ruby", TEXT, r"you can redistribute it and/or modify it under either the terms of the (?:gpl|2-clause bsdl)"),
    ("w3c", TEXT, r"by obtaining,? (?:using )?and/or copying this work, you \(the licensee\) agree that you have read"),
    ("wtfpl", TEXT, r"everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("wtfpl", TEXT, r"you just do what the f\S+ you want to"),
    ("beerware", TEXT, r"if we meet some day, and you think this stuff is worth it, you can buy me a beer in return"),
    ("postgresql", TEXT, r"provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("ncsa", TEXT, r"to deal with the software without restriction, including without limitation the rights to use"),
    ("ofl-1.1", TEXT, r"with reserved font name"),
    ("ofl-1.1", TEXT, r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", TEXT, r"the fonts and derivatives, however, cannot be released under any other type of license"),
    ("upl-1.0", TEXT, r"subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation"),
    ("ms-pl", TEXT, r"if you use the software, you accept this license\. if you do not accept the license, do not use the software"),
    ("ms-rl", TEXT, r"for any file you distribute that contains code from the software \(in source code or binary format\), you must provide recipients the source code"),
    ("osl-3.0", TEXT, r"licensed under the open software license version 3\.0"),
    ("afl-3.0", TEXT, r"licensed under the academic free license version 3\.0"),
    ("cecill-2.1", TEXT, r"this software is governed by the cecill(?:-[bc])? license under french law"),
    ("mulan-psl-2.0", TEXT, r"is licensed under mulan psl ?v2"),
    ("lppl-1.3", TEXT, r"this work may be distributed and/or modified under the conditions of the latex project public license"),
    ("odbl-1.0", TEXT, r"is made available under the open database license"),
    ("odbl-1.0", TEXT, r"any rights in individual contents of the database are licensed under the database contents license"),
    ("pddl-1.0", TEXT, r"is made available under the public domain dedication and license"),
    ("cc0-1.0", TEXT, r"has waived all copyright and related or neighbou?ring rights"),
    ("cc0-1.0", TEXT, r"dedicated the work to the public domain by waiving all of his or her rights"),
    ("cc0-1.0", TEXT, r"no copyright - public domain dedication"),
    ("cc-by", TEXT, r"this work is licensed under (?:a|the) creative commons attribution [1-4]\.[05] (?:international |generic |unported )?licen[sc]e"),
    ("cc-by-sa", TEXT, r"this work is licensed under (?:a|the) creative commons attribution-sharealike [1-4]\.[05]"),
    ("cc-by-nd", TEXT, r"this work is licensed under (?:a|the) creative commons attribution-noderiv(?:ative)?s [1-4]\.[05]"),
    ("cc-by-nc", TEXT, r"this work is licensed under (?:a|the) creative commons attribution-noncommercial [1-4]\.[05]"),
    ("cc-by-nc-sa", TEXT, r"this work is licensed under (?:a|the) creative commons attribution-noncommercial-sharealike [1-4]\.[05]"),
    ("cc-by-nc-nd", TEXT, r"this work is licensed under (?:a|the) creative commons attribution-noncommercial-noderiv(?:ative)?s [1-4]\.[05]"),
    ("cc-by-sa", NOTICE, r"text is available under the creative commons attribution-share-?alike licen[sc]e"),
    ("openrail", TEXT, r"you agree not to use the model or derivatives of the model"),
    ("vim", TEXT, r"vim is charityware\. you can use and copy it as much as you like"),
    ("tcl", TEXT, r"the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation"),
    ("icu", TEXT, r"provided that the above copyright notice\(s\) and this permission notice appear in all copies of the software"),
    ("unicode", TEXT, r"obtaining a copy of the unicode data files and any associated documentation"),
    ("json", TEXT, r"the software shall be used for good, not evil"),
    ("fair", TEXT, r"usage of the works is permitted provided that this instrument is retained with the works"),
    ("blue-oak-1.0", TEXT, r"this license gives everyone as much permission to work with this software as possible"),
    ("public-domain", TEXT, r"the author hereby (?:places|dedicates) (?:this|the) (?:work|code|software|file) (?:in|to) the public domain"),
    ("public-domain", TEXT, r"this (?:work|code|software|file) (?:is|has been) (?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", NAME, r"(?:in|into|to|under) the public domain\b"),
    ("bsd", NAME, r"\bbsd(?:-style)? licen[sc]e\b"),
    ("apache", NAME, r"\bapache (?:software )?licen[sc]e\b"),
    ("gpl", NAME, r"\b(?:gnu )?general public licen[sc]e\b"),
    ("lgpl", NAME, r"\b(?:gnu )?(?:lesser|library) general public licen[sc]e\b"),
    ("gpl", NAME, r"\b(?:gnu )?gpl(?:\s*v?[123](?:\.0)?)?\+?\b"),
    ("lgpl", NAME, r"\b(?:gnu )?lgpl(?:\s*v?[23](?:\.[01])?)?\+?\b"),
    ("agpl-3.0", NAME, r"\b(?:gnu )?agpl(?:\s*v?3(?:\.0)?)?\+?\b"),
    ("mpl", NAME, r"\bmozilla public licen[sc]e\b"),
    ("epl", NAME, r"\beclipse public licen[sc]e\b"),
    ("cddl", NAME, r"\bcommon development and distribution licen[sc]e\b"),
    ("artistic", NAME, r"\bartistic licen[sc]e\b"),
    ("creative-commons", NAME, r"\bcreative commons (?:attribution|licen[sc]e|zero)[\w\s-]{0,40}"),
    ("proprietary", NAME, r"\ball rights reserved\b"),
    ("proprietary", NAME, r"\bproprietary and confidential\b"),
    ("proprietary", NAME, r"\bend[\s-]user licen[sc]e agreement\b"),
    ("proprietary", NAME, r"unauthori[sz]ed copying of this file, via any medium,? is strictly prohibited"),
    ("proprietary", NAME, r"this software is the confidential and proprietary information of"),
    ("non-commercial", HINT, r"\b(?:for )?non-?commercial (?:use|purposes?)(?: only)?\b"),
    ("no-derivatives", HINT, r"\bmay not be (?:reproduced|redistributed|modified) without (?:prior )?(?:written )?permission\b"),
    ("copyright", HINT, r"\bcopyright\s+(?:\(c\)|\xa9)?\s*(?:19|20)\d\d\b[^\n]{0,60}"),
    ("spdx-other", HINT, r"spdx-license-identifier:\s*[\w.+-]+"),
]


@lru_cache(1)
def rules() -> list[tuple[str, int, re.Pattern]]:
    """(label, priority, pattern), in order of priority; a few hundred."""
    made = []
    for line in FAMILIES:
        label, name, tag, address = (x.strip() for x in re.split(r"\s\|\s", line))
        name = name.replace("{V}", V)
        made.append((label, NOTICE, rf"\b{UNDER}(?:{name})(?![\w])"))
        made.append((label, NOTICE, rf"\b(?:licen[sc]e|licen[sc]ed|licensing)\s*[:=]\s*{THE}(?:{name})(?![\w])"))
        made.append((label, NAME, rf"(?<![\w]){THE}(?:{name})(?![\w])"))
        made.append((label, TAG, rf"spdx-license-identifier:\s*(?:{tag})(?![\w.+-])"))
        made.append((label, TAG, rf"\blicense(?:_?id|_?name)?[\"']?\s*[:=]\s*[\"'](?:{tag})[\"']"))
        if address != "-":
            made.append((label, URL, rf"(?:https?://)?(?:www\.)?{address}[\w./-]*"))
    for line in SHORT:
        label, name = (x.strip() for x in re.split(r"\s\|\s", line))
        made.append((label, NOTICE, rf"\b(?:{UNDER}|(?:licen[sc]e|licen[sc]ed|licensing)\s*[:=]\s*{THE})(?:{name.replace('{V}', V)})(?![\w-])"))
    made += [(label, priority, re.sub(r"(?<!\[) (?!\?)", r"\\s+", words)) for label, priority, words in SENTENCES]
    return [(label, priority, re.compile(pattern)) for label, priority, pattern in sorted(made, key=lambda r: r[1])]


def keyword_sets(pattern: str) -> list[set[str]]:
    """Sets of literals: every match of the pattern holds a literal of each set.

    Runs of plain characters that every match must have, and for an
    alternation those of its branches, where each branch has one. Runs have
    three characters or more, or two where there are no such.
    """

    def walk(tree, least: int) -> list[set[str]]:
        found, run = [], ""
        for op, value in [*tree, (None, None)]:
            if op is parser.LITERAL:
                run += chr(value)
                continue
            if len(run) >= least:
                found.append({run})
            run = ""
            if op is parser.SUBPATTERN:
                found += walk(value[3], least)
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] >= 1:
                found += walk(value[2], least)
            elif op is parser.BRANCH:
                own = [walk(branch, least) for branch in value[1]]
                if all(own):
                    found.append(set().union(*(max(sets, key=lambda s: min(map(len, s))) for sets in own)))
        return found

    tree = parser.parse(pattern)
    return walk(tree, 3) or walk(tree, 2)


@lru_cache(1)
def _automaton() -> tuple[ahocorasick.Automaton, list[tuple[frozenset, ...]]]:
    """The automaton of all keywords, and each rule's sets, the most telling first."""
    gates, a = [], ahocorasick.Automaton()
    for _, _, p in rules():
        sets = keyword_sets(p.pattern)
        if not sets:
            raise ValueError(f"a rule without a keyword: {p.pattern}")
        for keyword in set().union(*sets):
            a.add_word(keyword, keyword)
        gates.append(tuple(frozenset(s) for s in sorted(sets, key=lambda s: -min(map(len, s)))))
    a.make_automaton()
    return a, gates


def detections(low: str) -> list[tuple[int, int, str, int]]:
    """All that the rules find in a lower-cased text: (start, end, label, priority), in rule order."""
    automaton, gates = _automaton()
    hit = {k for _, k in automaton.iter(low)}
    if not hit:
        return []
    return [
        (m.start(), m.end(), label, priority)
        for (label, priority, p), gate in zip(rules(), gates, strict=True)
        if not any(map(hit.isdisjoint, gate))
        for m in p.finditer(low)
    ]


def resolve(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Suppress detections that lie inside one accepted before.

    Order: priority, then the longer, then the earlier, then the label. Equal
    intervals count as contained. Partial overlaps stay. Accepted intervals
    are kept as an envelope in which neither contains another, so each
    question is one bisection.
    """
    kept: list[tuple[int, int, str, int]] = []
    starts: list[int] = []
    ends: list[int] = []
    for s, e, label, priority in sorted(found, key=lambda d: (d[3], d[0] - d[1], d[0], d[2])):
        i = bisect_right(starts, s)
        if i and ends[i - 1] >= e:
            continue
        kept.append((s, e, label, priority))
        lo = i - 1 if i and starts[i - 1] == s else i
        hi = lo
        while hi < len(ends) and ends[hi] <= e:
            hi += 1
        starts[lo:hi], ends[lo:hi] = [s], [e]
    return sorted(kept)


def base_places(low: bytes) -> tuple[int, list[tuple[int, str]]]:
    """The number of words, and (index of the first word, label) of every place of a base phrase."""
    raw = np.frombuffer(low, np.uint8)
    word = (raw >= 128) | ((raw >= 48) & (raw <= 57)) | ((raw >= 97) & (raw <= 122))
    begins = np.flatnonzero(word & ~np.concatenate(([False], word[:-1]))) if len(raw) else np.zeros(0, np.int64)
    places = [(m.start(), label) for label, p in BASE_PATTERNS for m in p.finditer(low)]
    return len(begins), [(int(np.searchsorted(begins, at)), label) for at, label in places]


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text."""
    raw = (text or "").encode().lower()  # bytes.lower touches A-Z only
    n, places = base_places(raw)
    spans = resolve(detections(raw.decode()))
    words = sorted(w for w, _ in places)
    base = {label for _, label in places}
    doubt = 1.0
    for _, p in sorted({(s[2], s[3]) for s in spans}):
        doubt *= 1 - WEIGHT[p]
    if places:
        doubt *= 1 - WEIGHT[NAME]
    return (
        n, len(places), words[0] if words else None, words[-1] if words else None, ",".join(sorted(base)),
        ",".join(sorted(base | {s[2] for s in spans})), 1 - doubt,
        [{"start": s, "end": e, "label": label, "priority": p} for s, e, label, p in spans],
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, word counts, base places, labels, score and the accepted spans of every row.

    A null or empty text has no words, no labels and score 0. Equal texts get
    equal values; rows are independent, so repeated ids and empty tables need
    no care. Columns other than doc_id and text are not read. Spans are in
    characters of the text with A-Z in lower case.
    """
    small_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches):
        for batch in batches:
            columns = list(zip(*(scan(x.as_py()) for x in batch.column(1)), strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,priority:long>>",
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, base places and labels of every document; odd rows as in ``license_scan``."""
    return license_scan(documents(spark, sf_dir)).drop("spans")
