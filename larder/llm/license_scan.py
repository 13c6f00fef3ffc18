"""License scans with ordered signature rules, in DataFrame functions only.

Each rule is a hand-written regular expression over the text's normalised words, keywords that gate it, a label, a
priority and a score. A rule's expression runs only in a text that contains its keywords, which every match of it
contains; which texts are looked at at all follows from the rules' keywords. Hits are intervals of characters; a hit that lies inside another hit of the same or a higher priority is
suppressed.

Defined results: null counts as an empty text, which has no words and no hits. Rows are judged one by one, repeated or
not; other columns are not looked at.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

RULE_TABLE = "array<struct<key:string,rules:array<struct<rule:int,label:string,keys:array<string>,expr:string,priority:int,score:double>>>>"
#: Items that are gathered at a time.
CHUNK = 128

_LIC = "(?:license|licence|licenses|licences)"
#: Fixed values, written by hand: label, keyword that is part of every name, the licence's names, the identifiers of its
#: short form (none where another row of the label has them).
NAMES = (
    ("mit", " mit ", "mit|mit x11", "mit"),
    ("mit", " expat ", "expat", ""),
    ("mit-0", " mit ", "mit no attribution|mit 0", "mit 0"),
    ("apache-1.1", "apache", "apache software license(?: version)? 1 1|apache 1 1", "apache 1 1"),
    ("apache-2", "apache", "apache(?: software)? license(?: version)? 2(?: 0)?|apache(?: version)? 2(?: 0)?", "apache 2 0"),
    ("apache-2", "asl 2 0", "asl 2 0", ""),
    ("bsd-2-clause", "bsd", "simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "original bsd|bsd 4 clause|4 clause bsd", "bsd 4 clause"),
    ("0bsd", "bsd", "zero clause bsd|0bsd|bsd zero clause", "0bsd"),
    ("isc", " isc ", "isc", "isc"),
    ("isc", "internet systems", "internet systems consortium", ""),
    ("gpl-1", "gpl", "gplv1|gpl(?: version| v)? 1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "gpl", "gplv2|gpl(?: version| v)? 2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "gpl", "gplv3|gpl(?: version| v)? 3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-2", "gnu general", "gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?", "gnu gpl 2 0"),
    ("gpl-3", "gnu general", "gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?", "gnu gpl 3 0"),
    ("gpl", "gnu general", "gnu general public license", "gnu gpl"),
    ("gpl", "gnu gpl", "gnu gpl", ""),
    ("lgpl-2.1", "lgpl", "lgplv2 1|lgpl(?: version| v)? 2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lgpl", "lgplv3|lgpl(?: version| v)? 3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "gnu lesser", "gnu lesser general public license(?: version| v)? 2 1", "gnu lgpl 2 1"),
    ("lgpl-3", "gnu lesser", "gnu lesser general public license(?: version| v)? 3(?: 0)?", "gnu lgpl 3 0"),
    ("lgpl", "gnu lesser", "gnu lesser general public license", "gnu lgpl"),
    ("lgpl", "gnu library", "gnu library general public license", "gnu library gpl"),
    ("agpl-3", "agpl", "agplv3|agpl(?: version| v)? 3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl-3", "affero", "(?:gnu )?affero general public license(?:(?: version| v)? 3(?: 0)?)?", "gnu agpl 3 0"),
    ("gfdl", "gnu free documentation", "gnu free documentation license", "gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? 1 [01]", "mpl 1 1"),
    ("mpl-2", "mozilla", "mozilla public license(?:(?: version| v)? 2(?: 0)?)?", "mozilla mpl 2 0"),
    ("mpl-2", "mpl", "mplv2|mpl(?: version| v)? 2(?: 0)?", "mpl 2 0"),
    ("epl-1", "eclipse", "eclipse public license(?: version| v)? 1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse", "eclipse public license(?: version| v)? 2(?: 0)?", "epl 2 0"),
    ("edl-1", "eclipse", "eclipse distribution license(?: version| v)? 1(?: 0)?", "edl 1 0"),
    ("cddl", "common development", "common development and distribution license", "cddl 1 [01]"),
    ("cpl-1", "common public", "common public license(?: version| v)? 1(?: 0)?", "cpl 1 0"),
    ("artistic-1", "artistic", "artistic license 1(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic", "artistic license 2(?: 0)?", "artistic 2 0"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("bsl-1", "boost", "boost software license(?:(?: version| v)? 1(?: 0)?)?", "bsl 1 0"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc0", "creative commons", "creative commons zero|creative commons cc0|creative commons public domain", "creative commons zero"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4] \\d)?(?: international| unported| generic)?", "creative commons by"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4] \\d)?", "creative commons by sa"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative|atives|s)(?: [1-4] \\d)?", "creative commons by nd"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4] \\d)?", "creative commons by nc"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike(?: [1-4] \\d)?", "creative commons by nc sa"),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)(?: [1-4] \\d)?", "creative commons by nc nd"),
    ("cc-by", "cc by", "cc by(?: [1-4] \\d)?", "cc by [1-4] 0"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1-4] \\d)?", "cc by sa [1-4] 0"),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1-4] \\d)?", "cc by nd [1-4] 0"),
    ("cc-by-nc", "cc by nc", "cc by nc(?: [1-4] \\d)?", "cc by nc [1-4] 0"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1-4] \\d)?", "cc by nc sa [1-4] 0"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1-4] \\d)?", "cc by nc nd [1-4] 0"),
    ("odbl", "open database", "open database license", "odbl 1 0"),
    ("ofl-1.1", "open font", "(?:sil )?open font license(?:(?: version| v)? 1 [01])?", "ofl 1 1"),
    ("python-2", "python software", "python software foundation license", "python 2 0"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("eupl", "european union", "european union public licen[cs]e", "eupl 1 [12]"),
    ("sspl-1", "server side", "server side public license", "sspl 1 0"),
    ("busl-1.1", "business source", "business source license(?: 1 1)?", "busl 1 1"),
    ("elastic-2", "elastic", "elastic license(?: 2(?: 0)?)?", "elastic 2 0"),
    ("rail", "rail", "(?:open|responsible ai) ?rail(?: m)?", "openrail"),
)
#: Fixed values, written by hand: contexts in which a name counts, with keyword, priority and score.
CONTEXTS = (
    ("spdx license identifier (?:{ids})", "spdx license identifier", 60, 1.0),
    ("(?:licensed|released|distributed|published|available|provided|covered) (?:to you )?under (?:the )?(?:terms of (?:the )?)?(?:{names})(?: " + _LIC + ")?", " under ", 50, 0.97),
    ("under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{names})(?: " + _LIC + ")?", " under ", 40, 0.9),
    ("subject to (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{names})(?: " + _LIC + ")?", " subject to ", 40, 0.9),
    (_LIC + " (?:is |type |name )?(?:the )?(?:{names})", " licen", 30, 0.8),
    ("(?:{names}) " + _LIC, " licen", 20, 0.7),
)
#: Fixed values, written by hand: sentences of licence texts: label, keyword, expression, priority, score.
NOTICES = (
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 55, 0.95),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 55, 0.95),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms", 55, 0.9),
    ("bsd-3-clause", "endorse or promote", "neither the name of (?:\\S+ ){1,12}nor the names of its contributors may be used to endorse or promote", 58, 0.95),
    ("gpl", "free software foundation", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 52, 0.93),
    ("apache-2", "compliance with the license", "you may not use this file except in compliance with the license", 55, 0.9),
    ("unlicense", "public domain", "free and unencumbered software released into the public domain", 55, 0.97),
    ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", 50, 0.85),
    ("public-domain", "public domain", "public domain dedication", 45, 0.8),
    ("zlib", "as is", "this software is provided as is without any express or implied warranty in no event will the authors", 54, 0.9),
    ("wtfpl", "what the", "do what the fuck you want to public license", 55, 0.97),
    ("proprietary", "all rights reserved", "all rights reserved", 10, 0.4),
    ("proprietary", "proprietary", "proprietary and confidential", 15, 0.6),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file", 15, 0.6),
    ("cc", "creative commons", "creative commons " + _LIC, 5, 0.5),
)
#: Fixed values, written by hand: further sentences, headers, addresses and titles of licences, in the same form.
SIGNATURES = (
    # permissive bodies
    ("mit", "without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", 54, 0.93),
    ("mit", "permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 53, 0.92),
    ("mit", "copyright holders be liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 30, 0.75),
    ("x11", "x consortium", "except as contained in this notice the names? of the x consortium shall not be used in advertising", 57, 0.95),
    ("ncsa", "to deal with the software", "to deal with the software without restriction", 56, 0.9),
    ("ncsa", "ncsa open source", "(?:university of illinois )?ncsa open source license", 50, 0.9),
    ("json", "good not evil", "the software shall be used for good not evil", 58, 0.95),
    ("isc", "permission notice appear in all copies", "with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 54, 0.93),
    ("0bsd", "with or without fee", "for any purpose with or without fee is hereby granted the software is provided as is", 57, 0.93),
    ("hpnd", "and its documentation for any purpose", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 56, 0.9),
    ("hpnd-sell", "and its documentation for any purpose", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 56, 0.9),
    ("ntp", "and its documentation for any purpose", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 56, 0.9),
    ("tcl", "the authors hereby grant", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", 56, 0.92),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice", 54, 0.88),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice", 54, 0.88),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 57, 0.94),
    ("bsd-3-clause", "promote products derived", "may be used to endorse or promote products derived from this software without specific prior written permission", 52, 0.88),
    ("bsd-2-clause-views", "views and conclusions", "the views and conclusions contained in the software and documentation are those of the authors", 56, 0.92),
    ("bsd", "copyright holders and contributors", "this software is provided by the copyright holders and contributors as is", 40, 0.8),
    ("bsd", "the regents and contributors", "this software is provided by the regents and contributors as is", 40, 0.8),
    ("apache-1.1", "developed by the apache software foundation", "this product includes software developed by the apache software foundation", 52, 0.85),
    ("apache-2", "agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 54, 0.92),
    ("apache-2", "apache org licenses", "apache org licenses license 2 0", 56, 0.95),
    ("apache-1.1", "apache org licenses", "apache org licenses license 1 1", 56, 0.95),
    ("apache-2", "no charge royalty free", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce", 54, 0.93),
    ("apache-2", "contributor license", "licensed to the apache software foundation asf under one or more contributor license agreements", 56, 0.95),
    ("apache-2-llvm", "llvm exception", "(?:llvm exceptions to the apache 2 0 license|apache 2 0 with llvm exceptions?)", 58, 0.96),
    ("zlib", "must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 54, 0.93),
    ("zlib", "plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented", 54, 0.93),
    ("zlib", "removed or altered from any source", "this notice may not be removed or altered from any source distribution", 52, 0.88),
    ("libpng", "png reference library", "the png reference library is supplied as is", 56, 0.94),
    ("bsl-1", "accompanying documentation covered", "obtaining a copy of the software and accompanying documentation covered by this license", 57, 0.95),
    ("bsl-1", "boost org license", "boost org license 1 0 txt", 57, 0.96),
    ("bsl-1", "see accompanying file", "see accompanying file license 1 0 txt", 55, 0.92),
    ("postgresql", "university of california be liable", "in no event shall the university of california be liable to any party for direct indirect special incidental", 50, 0.85),
    ("openssl", "openssl toolkit", "software developed by the openssl project for use in the openssl toolkit", 57, 0.95),
    ("ssleay", "eric young", "this product includes (?:cryptographic )?software written by eric young", 57, 0.95),
    ("php-3.01", "php software", "this product includes php software freely available from", 57, 0.94),
    ("php-3.01", "php license", "(?:the )?php license version 3 0?1?", 55, 0.93),
    ("python-2", "psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world ?wide license", 57, 0.95),
    ("cnri-python", "cnri hereby grants", "cnri hereby grants licensee a nonexclusive royalty free world ?wide license", 57, 0.95),
    ("ruby", "under either the terms", "you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)", 56, 0.92),
    ("w3c", "by obtaining using", "by obtaining using and or copying this work you the licensee agree that you have read", 56, 0.92),
    ("w3c", "w3c software", "w3c software (?:and document )?notice and license", 56, 0.94),
    ("curl", "curl license", "(?:the )?curl license", 50, 0.88),
    ("icu", "icu license", "icu license icu 1 8 1 and later", 56, 0.94),
    ("unicode", "unicode", "unicode(?: inc)? license agreement data files and software", 56, 0.94),
    ("ijg", "independent jpeg group", "this software is based in part on the work of the independent jpeg group", 56, 0.93),
    ("ftl", "freetype project", "(?:the )?freetype project license", 56, 0.93),
    ("bzip2", "bzip2", "this program bzip2 the associated library libbzip2 and all documentation are copyright", 56, 0.93),
    ("upl-1", "universal permissive", "universal permissive license(?: upl)?(?: version| v)? 1 0", 56, 0.94),
    ("ms-pl", "microsoft public", "microsoft public license(?: ms pl)?", 56, 0.94),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal license(?: ms rl)?", 56, 0.94),
    ("ms", "governs use of the accompanying", "this license governs use of the accompanying software if you use the software you accept this license", 50, 0.85),
    ("afl-3", "academic free", "academic free license(?: version| v)? 3 0", 56, 0.94),
    ("ecl-2", "educational community", "educational community license version 2 0", 56, 0.94),
    ("efl-2", "eiffel forum", "eiffel forum license(?: version)? 2", 56, 0.94),
    ("blueoak-1", "blue oak", "blue oak model license(?: version)?(?: 1 0 0)?", 56, 0.94),
    ("mulan-2", "mulan", "mulan (?:psl v2|permissive software license(?: version| v)? ?2)", 56, 0.94),
    ("fair", "this instrument is retained", "usage of the works is permitted provided that this instrument is retained with the works", 57, 0.95),
    ("beerware", "with this stuff", "as long as you retain this notice you can do whatever you want with this stuff", 57, 0.95),
    ("beerware", "buy me a beer", "you can buy me a beer in return", 55, 0.92),
    ("vim", "charityware", "vim is charityware", 57, 0.95),
    ("openldap", "openldap public", "(?:the )?openldap public license(?: version 2 8)?", 56, 0.94),
    ("miros", "miros", "miros licen[cs]e", 56, 0.92),
    ("gnu-all-permissive", "without royalty provided", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved", 58, 0.95),
    ("wtfpl", "as long as the name is changed", "changing it is allowed as long as the name is changed", 57, 0.95),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software", 57, 0.95),
    ("unlicense", "unlicense org", "unlicense org", 52, 0.9),
    ("sqlite-blessing", "may you do good", "may you do good and not evil may you find forgiveness for yourself and forgive others", 57, 0.95),
    # copyleft bodies
    ("gpl", "this program is free software", "this program is free software you can redistribute it and or modify", 40, 0.85),
    ("gpl", "in the hope that it will be useful", "this program is distributed in the hope that it will be useful but without any warranty", 40, 0.85),
    ("gpl", "along with this program", "you should have received a copy of the gnu general public license along with this program", 53, 0.93),
    ("gpl-2", "version 2 of the license", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 58, 0.97),
    ("gpl-3", "version 3 of the license", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 58, 0.97),
    ("gpl-2", "take away your freedom", "the licenses for most software are designed to take away your freedom to share and change it", 57, 0.95),
    ("gpl-3", "free copyleft license for software", "the gnu general public license is a free copyleft license for software and other kinds of works", 57, 0.95),
    ("gpl", "verbatim copies of this license document", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 45, 0.85),
    ("gpl-2", "gnu org", "gnu org licenses old licenses gpl 2 0", 57, 0.96),
    ("gpl-3", "gnu org", "gnu org licenses gpl 3 0", 57, 0.96),
    ("gpl", "gnu org", "gnu org licenses gpl", 50, 0.9),
    ("lgpl-2.1", "gnu org", "gnu org licenses old licenses lgpl 2 1", 57, 0.96),
    ("lgpl", "gnu org", "gnu org licenses lgpl", 50, 0.9),
    ("agpl-3", "gnu org", "gnu org licenses agpl(?: 3 0)?", 57, 0.96),
    ("gfdl", "gnu org", "gnu org licenses fdl(?: 1 [123])?", 57, 0.96),
    ("lgpl", "this library is free software", "this library is free software you can redistribute it and or modify", 45, 0.87),
    ("lgpl", "along with this library", "you should have received a copy of the gnu (?:lesser|library) general public license along with this library", 55, 0.94),
    ("lgpl-3", "incorporates the terms", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 58, 0.96),
    ("agpl-3", "network server software", "to ensure cooperation with the community in the case of network server software", 58, 0.96),
    ("agpl-3", "remote network interaction", "remote network interaction use with the gnu general public license", 58, 0.96),
    ("gpl-classpath", "combined work based on this library", "linking this library statically or dynamically with other modules is making a combined work based on this library", 58, 0.95),
    ("gpl-autoconf", "as a special exception", "as a special exception to the gnu general public license", 56, 0.93),
    ("gpl-gcc", "runtime library exception", "gcc runtime library exception", 57, 0.95),
    ("gfdl", "modify this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 58, 0.96),
    ("gfdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts", 56, 0.94),
    ("mpl-2", "source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0", 58, 0.97),
    ("mpl-2", "mpl was not distributed", "if a copy of the mpl was not distributed with this file you can obtain one at", 56, 0.94),
    ("mpl-1.1", "subject to the mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 58, 0.97),
    ("mpl-2-no-copyleft-exception", "secondary licenses", "incompatible with secondary licenses as defined by the mozilla public license v 2 0", 59, 0.97),
    ("npl-1.1", "netscape public", "netscape public license(?: version)?(?: 1 [01])?", 56, 0.94),
    ("epl", "this eclipse public", "the accompanying program is provided under the terms of this eclipse public license", 57, 0.95),
    ("epl", "accompanying materials are made available", "this program and the accompanying materials are made available under the terms of the eclipse public license", 55, 0.93),
    ("epl-1", "eclipse org legal", "eclipse org legal epl v10", 58, 0.96),
    ("epl-2", "eclipse org legal", "eclipse org legal epl (?:2 0|v20)", 58, 0.96),
    ("cpl-1", "this common public", "the accompanying program is provided under the terms of this common public license", 57, 0.95),
    ("ipl-1", "ibm public", "ibm public license(?: version| v)?(?: 1 0)?", 56, 0.94),
    ("artistic-1", "package may be copied", "the intent of this document is to state the conditions under which a package may be copied", 57, 0.95),
    ("perl", "terms as perl", "under the same terms as perl(?: 5)?(?: itself)?", 55, 0.92),
    ("osl-3", "open software license", "open software license(?: version| v)? 3 0", 56, 0.94),
    ("cecill", "governed by the cecill", "this software is governed by the cecill license under french law", 57, 0.95),
    ("cecill-b", "governed by the cecill", "this software is governed by the cecill b license under french law", 57, 0.95),
    ("cecill-c", "governed by the cecill", "this software is governed by the cecill c license under french law", 57, 0.95),
    ("eupl", "under the eupl", "licensed under the eupl(?:(?: version| v)? 1 [12])?", 56, 0.95),
    ("qpl-1", "q public", "(?:the )?q public license(?: version 1 0)?", 55, 0.92),
    ("sleepycat", "complete source code", "redistributions in any form must be accompanied by information on how to obtain complete source code", 57, 0.95),
    ("lppl", "latex project public", "latex project public license", 56, 0.94),
    ("apsl-2", "apple public source", "apple public source license(?: version| ver)?(?: 2 0)?", 56, 0.94),
    ("sissl", "sun industry standards", "sun industry standards source license", 56, 0.94),
    ("spl-1", "sun public", "sun public license(?: version)?(?: 1 0)?", 55, 0.92),
    ("zpl-2.1", "zope public", "zope public license(?: zpl)?(?: version)?(?: 2 [01])?", 56, 0.94),
    ("wxwindows", "wxwindows", "wxwindows library licen[cs]e", 56, 0.94),
    ("watcom-1", "watcom public", "(?:sybase )?open watcom public license", 56, 0.94),
    ("rpl-1.5", "reciprocal public", "reciprocal public license(?: version)?(?: 1 5)?", 55, 0.92),
    ("rpsl-1", "realnetworks", "realnetworks public source license", 56, 0.94),
    ("nokia", "nokia open source", "nokia open source license", 56, 0.94),
    ("intel", "intel open source", "intel open source license", 56, 0.94),
    ("cal-1", "cryptographic autonomy", "cryptographic autonomy license", 56, 0.94),
    ("parity", "parity public", "parity public license", 56, 0.94),
    ("hippocratic", "hippocratic", "hippocratic license", 56, 0.93),
    ("cern-ohl", "cern open hardware", "cern open hardware licen[cs]e", 56, 0.94),
    ("tapr-ohl", "tapr open hardware", "tapr open hardware license", 56, 0.94),
    ("shl", "solderpad", "solderpad hardware license", 56, 0.94),
    # creative commons and data
    ("cc-by", "creativecommons org", "creativecommons org licenses by [1-4] [05]", 57, 0.96),
    ("cc-by-sa", "creativecommons org", "creativecommons org licenses by sa [1-4] [05]", 57, 0.96),
    ("cc-by-nd", "creativecommons org", "creativecommons org licenses by nd [1-4] [05]", 57, 0.96),
    ("cc-by-nc", "creativecommons org", "creativecommons org licenses by nc [1-4] [05]", 57, 0.96),
    ("cc-by-nc-sa", "creativecommons org", "creativecommons org licenses by nc sa [1-4] [05]", 57, 0.96),
    ("cc-by-nc-nd", "creativecommons org", "creativecommons org licenses by nc nd [1-4] [05]", 57, 0.96),
    ("cc0", "creativecommons org", "creativecommons org publicdomain zero 1 0", 57, 0.96),
    ("public-domain", "creativecommons org", "creativecommons org publicdomain mark 1 0", 57, 0.96),
    ("cc0", "associated cc0", "the person who associated cc0 with this (?:work|deed) has waived", 58, 0.96),
    ("cc-by", "give appropriate credit", "you must give appropriate credit provide a link to the license and indicate if changes were made", 50, 0.88),
    ("cc-by-nc", "for commercial purposes", "you may not use the material for commercial purposes", 52, 0.88),
    ("cc-by-sa", "under the same license as the original", "you must distribute your contributions under the same license as the original", 52, 0.88),
    ("cc-by-nd", "distribute the modified material", "if you remix transform or build upon the material you may not distribute the modified material", 52, 0.88),
    ("cc", "this creative commons public", "the work as defined below is provided under the terms of this creative commons public license", 50, 0.85),
    ("odbl", "database is made available", "this (?:\\S+ ){0,4}database is made available under the open database license", 57, 0.95),
    ("odbl", "opendatacommons org", "opendatacommons org licenses odbl", 57, 0.96),
    ("odc-by", "opendatacommons org", "opendatacommons org licenses by", 57, 0.96),
    ("pddl", "opendatacommons org", "opendatacommons org licenses pddl", 57, 0.96),
    ("pddl", "public domain dedication and license", "public domain dedication and license", 56, 0.93),
    ("odc-by", "open data commons attribution", "open data commons attribution license", 56, 0.94),
    ("ogl-3", "open government licen", "open government licen[cs]e(?: version| v)?(?: 3 0)?", 54, 0.92),
    ("etalab-2", "licence ouverte", "licence ouverte(?: open licence)?", 54, 0.92),
    ("dl-de-by-2", "datenlizenz deutschland", "datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?", 56, 0.94),
    ("cdla-permissive", "community data license", "community data license agreement permissive", 57, 0.95),
    ("cdla-sharing", "community data license", "community data license agreement sharing", 57, 0.95),
    # fonts
    ("ofl-1.1", "this font software", "this font software is licensed under the sil open font license", 57, 0.96),
    ("ofl-1.1", "scripts sil org", "scripts sil org ofl", 56, 0.95),
    ("ubuntu-font", "ubuntu font", "ubuntu font licen[cs]e(?: version 1 0)?", 56, 0.94),
    ("ipa-font", "ipa font", "ipa font license agreement", 56, 0.94),
    ("bitstream-vera", "fonts accompanying this license", "obtaining a copy of the fonts accompanying this license", 57, 0.95),
    ("arphic", "arphic public", "arphic public license", 56, 0.94),
    # source available, models
    ("sspl-1", "service source code", "you must make the service source code available via network download", 57, 0.95),
    ("busl-1.1", "non production use", "create derivative works redistribute and make non production use of the licensed work", 57, 0.95),
    ("elastic-2", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service", 57, 0.95),
    ("commons-clause", "commons clause", "commons clause license condition", 57, 0.95),
    ("commons-clause", "right to sell the software", "the license does not grant to you the right to sell the software", 56, 0.93),
    ("polyform-noncommercial", "polyform", "polyform noncommercial license(?: 1 0 0)?", 57, 0.95),
    ("polyform-small-business", "polyform", "polyform small business license(?: 1 0 0)?", 57, 0.95),
    ("confluent-community", "confluent community", "confluent community license", 56, 0.94),
    ("rsal", "redis source available", "redis source available license", 56, 0.94),
    ("llama", "community license", "llama [234](?: [0-9])? community license(?: agreement)?", 57, 0.95),
    ("gemma", "gemma terms", "gemma terms of use", 56, 0.94),
    ("rail", "use based restrictions", "use based restrictions as referenced in paragraph", 54, 0.9),
    # public domain and reserved rights
    ("public-domain", "public domain by its author", "this work has been released into the public domain by its author", 56, 0.95),
    ("public-domain", "in the public domain", "this (?:file|work|software|code) is (?:hereby placed )?in the public domain", 52, 0.9),
    ("us-government", "united states government", "(?:as )?a work of the united states government", 50, 0.88),
    ("proprietary", "confidential and proprietary", "(?:contains|is the) confidential and proprietary information", 20, 0.65),
    ("proprietary", "retrieval system", "no part of this (?:publication|book|document|work) may be reproduced stored in a retrieval system or transmitted in any form", 25, 0.75),
    ("proprietary", "prior written permission", "may not be reproduced (?:or distributed )?without the prior written permission of", 20, 0.65),
    ("proprietary", "permission is prohibited", "reproduction in whole or in part without (?:written )?permission is prohibited", 20, 0.65),
    ("proprietary", "for internal use only", "for internal use only", 12, 0.45),
    ("proprietary", "not for redistribution", "not for redistribution", 12, 0.45),
    ("eula", "end user license", "end user license agreement", 30, 0.75),
    ("eula", "agree to be bound", "by installing (?:copying )?or (?:otherwise )?using the (?:software|product) you agree to be bound by the terms of", 35, 0.8),
)


def rules() -> list[tuple[str, tuple[str, ...], str, int, float]]:
    """(label, keywords, expression, priority, score): the contexts over the names, the notices and signatures, the base
    phrases. A rule's expression runs where all its keywords occur; every match of it contains them."""
    made = []
    for label, key, names, ids in NAMES:
        for text, gate, priority, score in CONTEXTS:
            if "{ids}" not in text:
                made.append((label, (key, gate), text.format(names=names), priority, score))
            elif ids:  # gated by the context and the identifier up to its first choice
                made.append((label, (gate, text.split("(?:")[0] + re.match("[a-z0-9 ]*", ids)[0]), text.format(ids=ids), priority, score))
    made += [(label, ("cc by nc" if "nc" in label else "cc by",), f"(?:{names})", 10, 0.6) for label, key, names, _ in NAMES if key.startswith("cc by")]
    return made + [(label, (key,), *rest) for label, key, *rest in NOTICES + SIGNATURES] + [(label, (phrase,), phrase, 35, 0.9) for phrase, label in BASE]


def gates(made: list) -> list[str]:
    """Strings of which every text that a rule can match contains one: the longest keyword of each rule, without those that
    contain another one."""
    longest = sorted({max(keys, key=lambda k: (len(k), k)) for _, keys, *_ in made}, key=lambda k: (len(k), k))
    out: list[str] = []
    for k in longest:
        if not any(g in k for g in out):
            out.append(k)
    return out


def normalised(text: Column) -> Column:
    """The text's words, A-Z lower-cased, each between single spaces; one space where there is no word."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _scan(items: Column, start: Column, step, item_type: str) -> Column:
    """The output of a running state over an array: step(state, item) gives (state, array of outputs). Outputs are gathered
    in chunks of CHUNK items, so that work grows little faster than the array."""
    none, chunks = F.array().cast(f"array<{item_type}>"), F.array().cast(f"array<array<{item_type}>>")

    def inner(acc, item):
        state, out = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def outer(acc, at):
        one = F.aggregate(F.slice(items, at + 1, F.lit(CHUNK)), F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return F.struct(one["state"].alias("state"), F.concat(acc["out"], F.array(one["out"])).alias("out"))

    starts = F.sequence(F.lit(0), F.size(items) - 1, F.lit(CHUNK))
    return F.when(F.size(items) == 0, none).otherwise(F.aggregate(starts, F.struct(start.alias("state"), chunks.alias("out")), outer, lambda a: F.flatten(a["out"])))


def _places(norm: Column, pattern: Column) -> Column:
    """Where the expression matches whole words: first and last character (from 0), first and last word. The text between
    matches and the matches are laid end to end, so each character is looked at once."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    between, found = F.split(norm, whole, -1), F.regexp_extract_all(norm, whole, F.lit(0))
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("between"), found.alias("found"))
    sizes = F.transform(pairs, lambda p: F.struct(F.length(p["between"]).alias("gap"), _spaces(p["between"]).alias("gap_words"), F.length(p["found"]).alias("n"), _spaces(p["found"]).alias("words")))

    def step(state, p):
        b, w = state["at"] + p["gap"], state["word"] + p["gap_words"]
        e, last = b + p["n"], w + p["words"]
        return F.struct(e.alias("at"), last.alias("word")), F.array(F.struct(b.alias("b"), e.alias("e"), w.alias("first"), last.alias("last")))

    return _scan(sizes, F.struct(F.lit(0).alias("at"), F.lit(-1).alias("word")), step, "struct<b:int,e:int,first:int,last:int>")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", signature_rules: list | None = None) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score and `hits` (label, first and last word,
    priority, score of each hit that stays) per row; no shuffle, no Python.

    signature_rules replaces `rules()`: rows of label, keyword or keywords that every match contains, expression over
    normalised words, priority, score."""
    made = rules() if signature_rules is None else [(a, (k,) if isinstance(k, str) else tuple(k), x, p, s) for a, k, x, p, s in signature_rules]
    # Rules by their longest keyword, so that a text is searched once for each keyword, not for each rule.
    by_key: dict[str, list] = {}
    for i, (label, keys, expr, priority, score) in enumerate(made):
        by_key.setdefault(max(keys, key=lambda k: (len(k), k)), []).append((i, label, keys, expr, priority, score))
    rule = lambda r: dict(zip(("rule", "label", "keys", "expr", "priority", "score"), r))
    table = F.from_json(F.lit(json.dumps([{"key": k, "rules": [*map(rule, rs)]} for k, rs in by_key.items()])), RULE_TABLE)  # one constant in the plan
    base = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(a).alias("label")) for p, a in BASE])
    hit_t = "struct<b:int,ne:int,np:int,rule:int,label:string,score:double,first:int,last:int>"
    place_t = "array<struct<first:int,label:string>>"
    norm = F.col("__norm")
    gate = F.lit(False)
    for g in gates(made) if signature_rules is None else gates(made + [("", (p,), p, 0, 0.0) for p, _ in BASE]):
        gate = gate | F.contains(norm, F.lit(g))
    df = docs.select(F.col(id_col), normalised(F.col(text_col)).alias("__norm"))
    df = df.select(id_col, "__norm", (_spaces(norm) - 1).cast("long").alias("n_words"), gate.alias("__gate"))

    found = F.flatten(F.transform(base, lambda p: F.when(F.contains(norm, p["phrase"]), F.transform(_places(norm, p["phrase"]), lambda x: F.struct(x["first"].alias("first"), p["label"].alias("label")))).otherwise(F.array().cast(place_t))))
    may = F.filter(F.flatten(F.transform(F.filter(table, lambda k: F.contains(norm, k["key"])), lambda k: k["rules"])), lambda r: F.forall(r["keys"], lambda k: F.contains(norm, k)))
    hits = F.flatten(
        F.transform(
            may,
            lambda r: F.transform(_places(norm, r["expr"]), lambda x: F.struct(x["b"].alias("b"), (-x["e"]).alias("ne"), (-r["priority"]).alias("np"), r["rule"], r["label"], r["score"], x["first"], x["last"])),
        )
    )
    df = df.withColumn("__base", F.when(F.col("__gate"), found).otherwise(F.array().cast(place_t)))
    df = df.withColumn("__hits", F.when(F.col("__gate"), F.array_sort(hits)).otherwise(F.array().cast(f"array<{hit_t}>")))

    # A hit comes after every hit that contains it, so one pass with the hits that are still open decides.
    def keep(open_hits, h):
        still = F.filter(open_hits, lambda o: o["ne"] < -h["b"])
        inside = F.exists(still, lambda o: (o["ne"] <= h["ne"]) & (o["np"] <= h["np"]))
        return F.when(inside, still).otherwise(F.concat(still, F.array(h))), F.when(inside, F.array().cast(f"array<{hit_t}>")).otherwise(F.array(h))

    df = df.withColumn("__kept", _scan(F.col("__hits"), F.array().cast(f"array<{hit_t}>"), keep, hit_t))
    base_labels = F.transform(F.col("__base"), lambda x: x["label"])
    return df.select(
        id_col,
        "n_words",
        F.size("__base").cast("long").alias("n_base"),
        F.array_min(F.transform("__base", lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("__base", lambda x: x["first"])).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base_labels, F.transform("__kept", lambda h: h["label"])))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("__kept", lambda h: h["score"])), F.lit(0.0)).alias("score"),
        F.transform("__kept", lambda h: F.struct(h["label"].alias("label"), h["first"].alias("first_word"), h["last"].alias("last_word"), (-h["np"]).alias("priority"), h["score"].alias("score"))).alias("hits"),
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan_licenses(table(spark, sf_dir, "documents")).drop("hits")
