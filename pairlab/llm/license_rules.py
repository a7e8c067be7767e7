"""Signature rules of the license scan, hand-written over normalised words.

Patterns see lower-case words with one space between them (``2.0`` is ``2 0``); a match takes the
space before its first word along and ends before a space. A rule is (label, keyword, pattern): the keyword is a literal part of every
match, so a text without it cannot match. In a label, ``{}`` takes the version that the
pattern captures. Tables stand in order of priority, and rules in order inside a table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Sentences of license texts and headers: weight 1.0.
SENTENCES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "deal in the software without restriction", "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", "neither the name of (?:\\S+ ){1,12}nor the names of (?:\\S+ ){1,4}contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", "the views and conclusions", "the views and conclusions contained in the software and documentation are those of the authors"),
    ("apache-{}", "licensed under the apache license", "licensed under the apache license version (\\d(?: \\d)?)(?: the license)? you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "terms and conditions for use", "terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache-1.1", "this product includes software developed by the apache", "this product includes software developed by the apache software foundation"),
    ("gpl-{}-or-later", "general public license", "under the terms of the gnu general public license as published by the free software foundation either version (\\d)(?: of the license)? or at your option any later version"),
    ("gpl-{}-only", "general public license", "under the terms of the gnu general public license version (\\d) as published by the free software foundation"),
    ("lgpl-{}-or-later", "general public license", "under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation either version (\\d(?: \\d)?)(?: of the license)? or at your option any later version"),
    ("lgpl-{}-only", "general public license", "under the terms of the gnu (?:lesser|library) general public license version (\\d(?: \\d)?) as published by the free software foundation"),
    ("agpl-{}-or-later", "general public license", "under the terms of the gnu affero general public license as published by the free software foundation either version (\\d)(?: of the license)? or at your option any later version"),
    ("gpl-3.0", "free copyleft license", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", "free copyleft license", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", "designed to take away your freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "a copy of the gnu general public", "you should have received a copy of the gnu general public license along with this (?:program|library|software|file)"),
    ("lgpl", "a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license along with this (?:program|library|software|file)"),
    ("gfdl-{}", "free documentation license", "copy distribute and or modify this document under the terms of the gnu free documentation license version (\\d(?: \\d)?)"),
    ("gpl-classpath-exception", "linking this library", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception", "runtime library exception", "under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception"),
    ("openssl-exception", "openssl", "permission to link the code of portions of this program with the openssl library"),
    ("mpl-{}", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v (\\d(?: \\d)?)"),
    ("mpl-{}", "mozilla public license", "the contents of this file are subject to the mozilla public license version (\\d(?: \\d)?)"),
    ("epl-{}", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?(\\d(?: \\d)?)"),
    ("cddl-{}", "common development and distribution", "the contents of this file are subject to the terms of the common development and distribution license version (\\d(?: \\d)?)"),
    ("cddl", "common development and distribution", "the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only gpl or )?the common development and distribution license"),
    ("cpl-1.0", "common public license", "the accompanying program is provided under the terms of this common public license"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "the origin of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "png reference library", "the png reference library is supplied as is"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want", "you just do what the fuck you want to"),
    ("boost-1.0", "machine executable object code", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("artistic-1.0", "artistic control", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "artistic control", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed the intent is that the copyright holder maintains some artistic control"),
    ("psf-2.0", "python software foundation", "this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("python", "beopen", "beopen com license agreement for python"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young"),
    ("ncsa", "associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("postgresql", "written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("w3c", "by obtaining using", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms"),
    ("unicode-dfs", "unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "font software", "the font software may not be sold by itself"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("json", "not evil", "the software shall be used for good not evil"),
    ("cc0-1.0", "dedicated the work to the public domain", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "waived all copyright", "to the extent possible under law (?:\\S+ ){1,12}?waived all copyright and related or neighboring rights"),
    ("public-domain", "no copyright is claimed", "no copyright is claimed in the united states"),
    ("public-domain", "dedicates", "dedicates (?:this|the) (?:software|work|code|file) to the public domain"),
    ("ms-pl", "microsoft public license", "this license governs use of the accompanying software if you use the software you accept this license (?:\\S+ ){0,400}?microsoft public license"),
    ("eupl-{}", "eupl", "licensed under the eupl version (\\d(?: \\d)?)"),
    ("sspl-1.0", "server side public license", "under the terms of the server side public license version 1"),
    ("elastic-2.0", "managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("bsl-1.1", "non production use", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("commons-clause", "right to sell", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("tcl", "regents of the university", "this software is copyrighted by the regents of the university of california sun microsystems"),
    ("curl", "stenberg", "copyright (?:c )?(?:\\d+ )+daniel stenberg"),
    ("ijg", "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", "portions of this software are copyright (?:\\S+ ){1,6}the freetype project"),
    ("infozip", "info zip", "this is version (?:\\S+ ){1,6}of the info zip (?:copyright and )?license"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution|use)(?: \\S+){0,6} (?:is )?(?:strictly )?prohibited"),
    ("proprietary", "permission of the copyright holder", "without (?:the )?(?:prior |express |written )+permission of the copyright holder"),
    ("non-commercial", "commercial", "(?:for )?non ?commercial (?:use|purposes) only"),
    ("non-commercial", "commercial", "may not be used for commercial purposes"),
    ("no-redistribution", "redistribut", "may not be (?:copied or )?redistributed"),
]

#: Names with what surrounds them: (label, keyword, pattern), weight 0.9 with a version or a licensing verb, else 0.7.
GRANT = "(?:licensed|released|distributed|available|published|provided|covered|made available)(?: under| according to| by)?(?: the)?(?: terms of)?(?: the)? "
NAMES = [
    ("apache-{}", "apache", "apache (?:software )?licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("apache-{}", "apache", "apache v?(\\d(?: \\d)?) licen[sc]e"),
    ("apache-2.0", "apache", "apache 2(?: 0)?"),
    ("apache", "apache", "apache (?:software )?licen[sc]e"),
    ("agpl-{}", "affero", "(?:gnu )?affero general public licen[sc]e(?: agpl)?(?: v| version)? ?(\\d(?: \\d)?)"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e"),
    ("agpl-{}", "agpl", "(?:gnu )?agpl ?v?(?:ersion )?(\\d(?: \\d)?)"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("lgpl-{}", "general public", "(?:gnu )?(?:lesser|library) general public licen[sc]e(?: lgpl)?(?: v| version)? ?(\\d(?: \\d)?)"),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("lgpl-{}", "lgpl", "(?:gnu )?lgpl ?v?(?:ersion )?(\\d(?: \\d)?)"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("gpl-{}-or-later", "general public", "(?:gnu )?general public licen[sc]e(?: gpl)?(?: v| version)? ?(\\d(?: 0)?) or(?: at your option)?(?: any)? (?:later|newer)(?: version)?"),
    ("gpl-{}", "general public", "(?:gnu )?general public licen[sc]e(?: gpl)?(?: v| version)? ?(\\d(?: 0)?)"),
    ("gpl", "general public", "(?:gnu )?general public licen[sc]e"),
    ("gpl-{}-or-later", "gpl", "(?:gnu )?gpl ?v?(?:ersion )?(\\d(?: 0)?) or (?:later|newer)"),
    ("gpl-{}", "gpl", "(?:gnu )?gpl ?v?(?:ersion )?(\\d(?: 0)?)"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("gfdl-{}", "free documentation", "(?:gnu )?free documentation licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[sc]e"),
    ("gfdl", "gfdl", "(?:gnu )?gfdl"),
    ("mit-0", "mit", "mit (?:0|no attribution)(?: licen[sc]e)?"),
    ("mit", "mit", "mit(?: x11| expat)?(?: style)? licen[sc]e"),
    ("mit", "mit", GRANT + "mit"),
    ("mit", "expat", "expat licen[sc]e"),
    ("x11", "x11", "x11 licen[sc]e"),
    ("isc", "isc", "isc licen[sc]e"),
    ("bsd-2-clause", "bsd", "(?:bsd(?: licen[sc]e)? 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", "(?:bsd(?: licen[sc]e)? 3 clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", "(?:bsd(?: licen[sc]e)? 4 clause|(?:4|four) clause bsd|original bsd)(?: licen[sc]e)?"),
    ("0bsd", "bsd", "(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?"),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]e"),
    ("bsd", "bsd", GRANT + "bsd"),
    ("mpl-{}", "mozilla", "mozilla public licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("mpl", "mozilla", "mozilla public licen[sc]e"),
    ("mpl-{}", "mpl", "mpl ?v?(\\d \\d)"),
    ("epl-{}", "eclipse", "eclipse public licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("epl", "eclipse", "eclipse public licen[sc]e"),
    ("epl-{}", "epl", "epl ?v?(\\d \\d)"),
    ("edl-1.0", "eclipse", "eclipse distribution licen[sc]e(?: v| version)?(?: 1(?: 0)?)?"),
    ("cddl-{}", "common development", "common development and distribution licen[sc]e(?: cddl)?(?: v| version)? ?(\\d(?: \\d)?)"),
    ("cddl", "common development", "common development and distribution licen[sc]e"),
    ("cddl-{}", "cddl", "cddl ?v?(\\d(?: \\d)?)"),
    ("cddl", "cddl", "cddl"),
    ("cpl-1.0", "common public", "common public licen[sc]e(?: v| version)?(?: 1(?: 0)?)?"),
    ("cpal-1.0", "common public attribution", "common public attribution licen[sc]e(?: v| version)?(?: 1(?: 0)?)?"),
    ("ipl-1.0", "ibm public", "ibm public licen[sc]e(?: v| version)?(?: 1(?: 0)?)?"),
    ("apsl-{}", "apple public", "apple public source licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("spl-1.0", "sun public", "sun public licen[sc]e(?: v| version)?(?: 1(?: 0)?)?"),
    ("npl-{}", "netscape", "netscape public licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("rpl-{}", "reciprocal", "reciprocal public licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e"),
    ("osl-{}", "open software", "open software licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("afl-{}", "academic free", "academic free licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("ecl-{}", "educational community", "educational community licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("eupl-{}", "european union public", "european union public licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("eupl", "eupl", "eupl"),
    ("cecill-{}", "cecill", "cecill (?:free software )?(?:licen[sc]e )?(?:agreement )?(?:v|version )?(\\d(?: \\d)?|b|c)"),
    ("cecill", "cecill", "cecill"),
    ("artistic-{}", "artistic", "artistic licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("artistic", "artistic", "(?:perl )?artistic licen[sc]e"),
    ("perl", "perl", "same terms as perl(?: itself)?"),
    ("ruby", "ruby", "ruby licen[sc]e|same terms as ruby(?: itself)?"),
    ("php-{}", "php", "php licen[sc]e(?: v| version)? ?(\\d(?: \\d+)?)"),
    ("psf-2.0", "python software foundation", "python software foundation licen[sc]e"),
    ("python", "python", "python licen[sc]e"),
    ("zpl-{}", "zope", "zope public licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", "libpng licen[sc]e"),
    ("bzip2", "bzip2", "bzip2 licen[sc]e"),
    ("boost-1.0", "boost", "boost software licen[sc]e(?: v| version)?(?: 1(?: 0)?)?"),
    ("openssl", "openssl", "openssl licen[sc]e"),
    ("postgresql", "postgresql", "postgresql licen[sc]e"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("intel", "intel", "intel open source licen[sc]e"),
    ("w3c", "w3c", "w3c (?:software )?(?:notice and )?licen[sc]e"),
    ("unicode-dfs", "unicode", "unicode (?:data files|licen[sc]e agreement|terms of use)"),
    ("ofl-{}", "open font", "(?:sil )?open font licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("ofl", "open font", "(?:sil )?open font licen[sc]e"),
    ("ubuntu-font-1.0", "ubuntu font", "ubuntu font licen[sc]e(?: v| version)?(?: 1(?: 0)?)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("wtfpl", "do what the", "do what the fuck you want to public licen[sc]e"),
    ("beerware", "beer", "beer ?ware(?: licen[sc]e)?"),
    ("sspl-1.0", "server side", "server side public licen[sc]e"),
    ("bsl-1.1", "business source", "business source licen[sc]e(?: 1 1)?"),
    ("elastic-2.0", "elastic", "elastic licen[sc]e(?: v| version)?(?: 2(?: 0)?)?"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|free trial|strict|shield|perimeter)(?: licen[sc]e)?"),
    ("commons-clause", "commons clause", "commons clause"),
    ("confluent", "confluent", "confluent community licen[sc]e"),
    ("upl-1.0", "universal permissive", "universal permissive licen[sc]e"),
    ("mulan-psl-{}", "mulan", "mulan (?:psl|permissive software licen[sc]e)(?: v| version)? ?(\\d)"),
    ("blueoak-1.0.0", "blue oak", "blue oak model licen[sc]e"),
    ("odbl-1.0", "database", "open (?:data commons open )?database licen[sc]e"),
    ("odc-by-1.0", "open data commons", "open data commons attribution licen[sc]e"),
    ("pddl-1.0", "public domain dedication", "(?:open data commons )?public domain dedication and licen[sc]e"),
    ("cdla-{}", "community data", "community data licen[sc]e agreement (permissive|sharing)"),
    ("ogl-uk-{}", "open government", "open government licen[sc]e(?: v| version)? ?(\\d(?: \\d)?)"),
    ("ogl", "open government", "open government licen[sc]e"),
    ("llama-{}", "llama", "llama ?(\\d(?: \\d)?)? community licen[sc]e(?: agreement)?"),
    ("openrail", "rail", "(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[sc]e)?"),
    ("cc0-1.0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons zero", "creative commons zero"),
    ("cc-pdm-1.0", "public domain mark", "public domain mark(?: 1 0)?"),
    ("public-domain", "public domain", "(?:in|into|to) the public domain"),
    ("public-domain", "public domain", "public domain"),
    ("proprietary", "end user", "end user licen[sc]e agreement"),
    ("proprietary", "eula", "eula"),
    ("copyright", "copyright", "copyright (?:c )?(?:\\d{4}(?: \\d{2,4})*)"),
    ("copyright", "copyright", "all copyrights?(?: are)? reserved"),
    ("reserved", "rights", "(?:all|some) rights reserved"),
    ("alle-rechte", "rechte", "alle rechte vorbehalten"),
    ("tous-droits", "droits", "tous droits réservés"),
    ("todos-derechos", "derechos", "todos los derechos reservados"),
]

#: Generic clues: weight 0.3.
CLUES = [
    ("license-reference", "licen", "(?:see|read|refer to)(?: the)?(?: file)? (?:licen[sc]e|copying)(?: txt| md| file)?(?: for (?:details|terms|more information))?"),
    ("license-reference", "governed by", "governed by (?:a|the) (?:\\S+ ){0,6}licen[sc]e that can be found in the licen[sc]e file"),
    ("license-reference", "licen", "(?:licensed|released|distributed|published) under (?:a|an|the)(?: \\S+){0,5}? licen[sc]e"),
    ("license-reference", "licen", "subject to the (?:following )?licen[sc]e(?: terms)?"),
    ("warranty-disclaimer", "warrant", "without (?:any )?warrant(?:y|ies)(?: of any kind)?"),
    ("warranty-disclaimer", "as is", "provided as is"),
    ("warranty-disclaimer", "merchantability", "merchantability (?:and|or) fitness for a particular purpose"),
    ("warranty-disclaimer", "liable", "in no event shall the (?:\\S+ ){1,8}be liable"),
    ("free-software", "free software", "(?:this|it) (?:\\S+ )?is free software"),
    ("open-source", "open source", "open source licen[sc]e"),
    ("permission", "permission", "(?:used|reproduced|reprinted) (?:with|by)(?: kind)? permission"),
    ("permission", "no part of this", "no part of this (?:\\S+ )?(?:publication|work|book|document) may be reproduced"),
]

#: Identifiers that may follow a license tag or a license address: label = identifier.
IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 "
    "Beerware BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 bzip2-1.0.6 "
    "CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP FTL "
    "GFDL-1.2 GFDL-1.3 GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-2.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0 HPND ICU IJG "
    "Intel IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-2.1 LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0 "
    "Libpng LPL-1.02 MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1 ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 "
    "PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.5 Ruby SISSL Sleepycat SPL-1.0 SSPL-1.0 TCL UPL-1.0 Unicode-DFS-2016 "
    "Unlicense Vim W3C WTFPL X11 Xnet Zlib ZPL-2.1"
).split()

CC_PARTS = ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")
CC_WORDS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}

#: Phrases whose places are counted for the base columns: (label, phrase).
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern
    weight: float

    def name(self, match: re.Match) -> str:
        """The label, with the version that was found (``2`` is ``2.0``)."""
        version = (match.group(1) or b"").decode().replace(" ", ".") if match.re.groups else ""
        return self.label.replace("{}", f"{version}.0" if version.isdigit() else version).strip("-")


def words_of(text: str) -> str:
    """An ASCII name as the words it is scanned for."""
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def _rule(label: str, keyword: str, pattern: str, weight: float) -> Rule:
    return Rule(label, keyword, re.compile(f" (?:{pattern})(?= )".encode()), weight)


def build_rules() -> list[Rule]:
    """All rules, highest priority first."""
    out = [_rule(*r, 1.0) for r in SENTENCES]
    for name in sorted(IDENTIFIERS, key=lambda x: (-len(x), x)):  # longer identifiers before their beginnings
        out.append(_rule(name.lower(), "spdx", f"spdx licen[sc]e identifier {words_of(name)}", 1.0))
        out.append(_rule(name.lower(), "org licenses", f"(?:spdx|opensource) org licenses {words_of(name)}(?: html| txt)?", 0.9))
    out.append(_rule("apache-{}", "apache org licenses", "apache org licenses license (\\d \\d)(?: html| txt)?", 0.9))
    out.append(_rule("{}", "gnu org", "gnu org (?:licenses|copyleft) (a?gpl|lgpl|fdl)(?: \\d \\d)?(?: html| txt| en html)?", 0.9))
    for parts in CC_PARTS:
        label, named = "cc-" + parts.replace(" ", "-"), " ".join(CC_WORDS[p] for p in parts.split())
        for version, tail in (("-{}", " (\\d \\d)"), ("", "")):
            weight = 0.9 if version else 0.7
            out.append(_rule(label + version, "creativecommons", f"creativecommons org licenses {parts}{tail}", weight))
            out.append(_rule(label + version, "cc", f"cc {parts}(?: v| version)?{tail}", weight))
            out.append(_rule(label + version, "creative commons", f"creative commons(?: licen[sc]e)? {named}(?: (?:international|generic|unported))?(?: licen[sc]e)?(?: v| version)?{tail}", weight))
    out += [_rule(label, key, pattern, 0.9 if "{}" in label else 0.7) for label, key, pattern in NAMES]
    out.append(_rule("creative-commons", "creative commons", "creative commons(?: licen[sc]e)?", 0.5))
    out += [_rule(*r, 0.3) for r in CLUES]
    return out
