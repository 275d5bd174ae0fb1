"""License scan with ordered signature rules, in built-in SQL functions only.

A text is lower-cased (A-Z), read as a sequence of words (runs of a-z, 0-9 and non-ASCII characters)
and joined with single blanks.  Rules are regular expressions over that word string.  A rule is tried
only if the text holds one of the rule's keywords and, for a statement about a named license, one of
the statement's own words; every place of a rule holds them, so that no detection is lost.  Every place a rule
matches is a detection.  Of detections whose intervals are nested the wider stays; of equal intervals that of the
smallest priority stays.  All of it happens within the text's row: there is no shuffle, and a row needs memory in
proportion to its text.

Defined results: null counts as empty; a text without words has no detections; texts are read whole;
repeated rows get equal results; columns named like the results are replaced, others carried along, whatever
their names.
The score is the largest weight of a detection that stays, 0 without any.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The phrases of the base contract, by label.
BASE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: label, keyword (or several, with "|") that every place of the pattern holds, and how the license is named in running words.
NAMES: list[tuple[str, str, str]] = [
    ("mit", "mit", r"(?:the )?mit"),
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("apache-2", "apache", r"(?:the )?apache(?: software)?(?: license| licence)?(?: version)?(?: v)? ?2(?: 0)?"),
    ("apache-1.1", "apache", r"(?:the )?apache(?: software)?(?: license| licence)?(?: version)? 1 1"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:3 clause bsd|bsd 3 clause|new bsd|revised bsd|modified bsd)"),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:4 clause bsd|bsd 4 clause|original bsd|old bsd)"),
    ("0bsd", "bsd", r"(?:the )?(?:0bsd|zero clause bsd|bsd zero clause)"),
    ("gpl-1", "general public", r"(?:the )?(?:gnu )?general public license(?: version)?(?: v)? ?1(?: 0)?"),
    ("gpl-2", "general public", r"(?:the )?(?:gnu )?general public license(?: version)?(?: v)? ?2(?: 0)?"),
    ("gpl-3", "general public", r"(?:the )?(?:gnu )?general public license(?: version)?(?: v)? ?3(?: 0)?"),
    ("gpl-2", "gpl", r"(?:the )?(?:gnu )?gpl ?(?:version |v )?(?:v)?2(?: 0)?"),
    ("gpl-3", "gpl", r"(?:the )?(?:gnu )?gpl ?(?:version |v )?(?:v)?3(?: 0)?"),
    ("lgpl-2.1", "lesser general public", r"(?:the )?(?:gnu )?lesser general public license(?: version)?(?: v)? ?2(?: 1)?"),
    ("lgpl-3", "lesser general public", r"(?:the )?(?:gnu )?lesser general public license(?: version)?(?: v)? ?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:the )?(?:gnu )?lgpl ?(?:version |v )?(?:v)?2(?: 1)?"),
    ("lgpl-3", "lgpl", r"(?:the )?(?:gnu )?lgpl ?(?:version |v )?(?:v)?3(?: 0)?"),
    ("agpl-3", "affero", r"(?:the )?(?:gnu )?affero general public license(?: version)?(?: v)? ?3?(?: 0)?"),
    ("agpl-3", "agpl", r"(?:the )?(?:gnu )?agpl ?(?:version |v )?(?:v)?3(?: 0)?"),
    ("gfdl", "free documentation", r"(?:the )?(?:gnu )?free documentation license(?: version)?(?: 1 [123])?"),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public license(?: version)? 1 1"),
    ("mpl-2", "mozilla", r"(?:the )?mozilla public license(?: version)?(?: v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", r"(?:the )?eclipse public license(?: version)?(?: v)? ?1(?: 0)?"),
    ("epl-2", "eclipse", r"(?:the )?eclipse public license(?: version)?(?: v)? ?2(?: 0)?"),
    ("cddl-1", "common development", r"(?:the )?common development and distribution license(?: version)?(?: 1 [01])?"),
    ("cpl-1", "common public", r"(?:the )?common public license(?: version)?(?: 1 0)?"),
    ("ipl-1", "ibm public", r"(?:the )?ibm public license(?: version)?(?: 1 0)?"),
    ("artistic-1", "artistic", r"(?:the )?artistic license(?: version)? 1(?: 0)?"),
    ("artistic-2", "artistic", r"(?:the )?artistic license(?: version)? 2(?: 0)?"),
    ("isc", "isc", r"(?:the )?isc"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?"),
    ("libpng", "libpng", r"(?:the )?libpng"),
    ("boost-1", "boost", r"(?:the )?boost software license(?: version)?(?: 1 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl(?: version)?(?: 2)?"),
    ("beerware", "beer", r"(?:the )?beer ?ware"),
    ("ofl-1.1", "open font", r"(?:the )?(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("python-2", "python|psf license", r"(?:the )?(?:psf|python software foundation|python) license(?: version)?(?: 2)?"),
    ("php-3", "php", r"(?:the )?php license(?: version)?(?: 3(?: 0[01]?)?)?"),
    ("ruby", "ruby", r"(?:the )?ruby"),
    ("postgresql", "postgresql", r"(?:the )?postgresql"),
    ("x11", "x11", r"(?:the )?x11"),
    ("openssl", "openssl", r"(?:the )?openssl"),
    ("upl-1", "universal permissive", r"(?:the )?universal permissive license(?: version)?(?: 1 0)?"),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois )?ncsa(?: open source)?"),
    ("eupl-1.2", "european union public", r"(?:the )?european union public licen[cs]e(?: version)?(?: v)?(?: 1 [12])?"),
    ("cecill-2.1", "cecill", r"(?:the )?cecill(?: [abc])?(?: version)?(?: 2 [01])?"),
    ("ms-pl", "microsoft public", r"(?:the )?microsoft public license"),
    ("ms-rl", "microsoft reciprocal", r"(?:the )?microsoft reciprocal license"),
    ("odbl-1", "database license", r"(?:the )?open (?:data commons )?(?:open )?database license(?: version)?(?: 1 0)?"),
    ("pddl-1", "public domain dedication", r"(?:the )?(?:open data commons )?public domain dedication and license"),
    ("bsl-1.1", "business source", r"(?:the )?business source license(?: version)?(?: 1 1)?"),
    ("sspl-1", "server side public", r"(?:the )?server side public license(?: version)?(?: 1)?"),
    ("elastic-2", "elastic", r"(?:the )?elastic license(?: version)?(?: 2 0)?"),
    ("cc0-1", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?(?! (?:nc|sa|nd)\b)"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?(?! (?:sa|nd)\b)"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?(?! (?:noncommercial|non|share|no)\b)"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?! (?:share|no)\b)"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?"),
    ("public-domain", "public domain", r"(?:the )?public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
]

#: kind, weight, and the words around a name; "{}" is where the name stands.
STATEMENTS: list[tuple[str, float, str]] = [
    ("grant", 1.0, r"(?:dual )?licensed (?:to you )?under (?:the terms of )?(?:the )?{}(?: licen[cs]e)?"),
    ("release", 0.95, r"(?:released|distributed|published|available|provided) under (?:the terms of )?(?:the )?{}(?: licen[cs]e)?"),
    ("identifier", 1.0, r"spdx license identifier {}"),
    ("terms", 0.9, r"(?:subject to|governed by|under|in accordance with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{} licen[cs]e"),
    ("field", 0.8, r"licen[cs]e(?:s|d)?(?: type| name)? {}"),
    ("name", 0.6, r"{} licen[cs]e"),
]

#: Rules that stand alone: label, keyword, weight, pattern.
NOTICES: list[tuple[str, str, float, str]] = [
    ("mit", "permission is hereby granted", 1.0, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify", 1.0, r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd-3-clause", "neither the name", 0.9, r"neither the name of (?:\S+ ){1,12}?nor the names of its contributors"),
    ("bsd-2-clause", "redistribution and use", 0.8, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2", "apache", 1.0, r"you may not use this file except in compliance with the license(?: you may obtain a copy of the license at)? (?:\S+ ){0,6}?apache"),
    ("apache-2", "apache", 0.9, r"(?:www )?apache org licenses license 2 0"),
    ("apache-2", "apache", 0.7, r"apache license version 2(?: 0)?"),
    ("gpl-2", "either version 2", 0.9, r"either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3", "either version 3", 0.9, r"either version 3 of the license or (?:at your option )?any later version"),
    ("gpl-3", "general public", 0.7, r"(?:gnu )?general public license version 3(?: 0)?"),
    ("gpl-2", "general public", 0.7, r"(?:gnu )?general public license version 2(?: 0)?"),
    ("gpl", "general public", 0.5, r"(?:gnu )?general public license"),
    ("mpl-2", "mozilla", 0.9, r"subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered", 1.0, r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", 0.7, r"(?:placed|dedicated|released) (?:in|to|into) the public domain"),
    ("zlib", "altered source", 0.9, r"altered source versions must be plainly marked as such"),
    ("boost-1", "boost", 0.9, r"distributed under the boost software license version 1 0"),
    ("wtfpl", "do what the fuck", 1.0, r"do what the fuck you want to public license"),
    ("cc-by-nc", "cc by nc", 0.8, r"cc by nc(?: [1-4] [05])?"),
    ("cc-by", "creativecommons", 0.8, r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", 0.8, r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons", 0.8, r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons", 0.8, r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", 0.8, r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", 0.8, r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0-1", "creativecommons", 0.8, r"creativecommons org publicdomain zero 1 0"),
    ("proprietary", "all rights reserved", 0.5, r"all rights reserved"),
    ("mit", "mit", 0.7, r"under the mit license"),
    # Passages of license texts.
    ("mit", "this permission notice", 0.9, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "modify merge publish", 0.9, r"rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd-2-clause", "must retain the above copyright", 0.7, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "must reproduce the above copyright", 0.7, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse or promote products", 0.85, r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials", 0.95, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", "unless required by applicable law", 0.9, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "contributor license agreements", 0.6, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "developed by the apache software foundation", 0.8, r"this product includes software developed by the apache software foundation"),
    ("gpl", "free software you can redistribute it", 0.9, r"free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software you can redistribute it", 0.95, r"free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl-3", "affero general public license as published", 0.95, r"affero general public license as published by the free software foundation"),
    ("gpl", "should have received a copy of the gnu", 0.8, r"you should have received a copy of the gnu general public license"),
    ("lgpl", "should have received a copy of the gnu", 0.85, r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl-3", "should have received a copy of the gnu", 0.9, r"you should have received a copy of the gnu affero general public license"),
    ("gpl-2", "franklin", 0.6, r"free software foundation inc 51 franklin (?:st|street) fifth floor boston"),
    ("gpl-2", "licenses for most software are", 0.95, r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "most software and other practical works", 0.95, r"the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("agpl-3", "network server software", 0.95, r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("lgpl-2.1", "either version 2 1", 0.9, r"either version 2 1 of the license or (?:at your option )?any later version"),
    ("gpl", "copies of this license document", 0.5, r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl-2", "library general public", 0.8, r"(?:gnu )?library general public license(?: version 2(?: 0)?)?"),
    ("mpl-2", "this source code form is subject", 1.0, r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-2", "incompatible with secondary licenses", 0.8, r"incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", "contents of this file are subject to the mozilla", 0.95, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", "accompanying materials are made available", 0.95, r"the accompanying materials are made available under the terms of the eclipse public license (?:version|v) ?1 0"),
    ("epl-2", "accompanying materials are made available", 0.95, r"the accompanying materials are made available under the terms of the eclipse public license (?:version|v) ?2 0"),
    ("cddl-1", "common development and distribution", 0.9, r"subject to the terms of the common development and distribution license"),
    ("boost-1", "machine executable object code", 0.95, r"solely in the form of machine executable object code generated by a source language processor"),
    ("zlib", "must not be misrepresented", 0.95, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "be held liable for any damages arising", 0.6, r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("zlib", "may not be removed or altered", 0.6, r"this notice may not be removed or altered from any source distribution"),
    ("unlicense", "anyone is free to copy modify publish", 0.95, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do what the fuck", 1.0, r"you just do what the fuck you want to"),
    ("beerware", "buy me a beer", 0.95, r"you can buy me a beer in return"),
    ("json", "good not evil", 1.0, r"the software shall be used for good not evil"),
    ("python-2", "psf hereby grants licensee", 0.95, r"psf hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("openssl", "openssl toolkit", 0.95, r"developed by the openssl project for use in the openssl toolkit"),
    ("php-3", "includes php software", 0.9, r"this product includes php software freely available from"),
    ("postgresql", "without a written agreement is hereby granted", 0.8, r"without fee and without a written agreement is hereby granted"),
    ("x11", "x consortium", 0.7, r"the name of the x consortium shall not be used in advertising"),
    ("ncsa", "deal with the software without restriction", 0.9, r"to deal with the software without restriction including without limitation the rights"),
    ("ofl-1.1", "reserved font name", 0.9, r"with reserved font names?"),
    ("ofl-1.1", "may be sold by itself", 0.9, r"individual components in original or modified versions may be sold by itself"),
    ("elastic-2", "hosted or managed service", 0.9, r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1", "making the functionality of the program", 0.8, r"making the functionality of the program or (?:a )?modified version available to third parties as a service"),
    ("bsl-1.1", "additional use grant", 0.8, r"additional use grant"),
    ("upl-1", "the larger works", 0.8, r"the software and the larger works"),
    ("cc-by", "must give appropriate credit", 0.7, r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "use the material for commercial purposes", 0.85, r"you may not use the material for commercial purposes"),
    ("cc-by-sa", "distribute your contributions under the same license", 0.85, r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", "distribute the modified material", 0.85, r"you may not distribute the modified material"),
    ("cc0-1", "to the extent possible under law", 0.9, r"to the extent possible under law (?:\S+ ){1,12}?ha(?:s|ve) (?:waived|dedicated)"),
    ("cc-by-nc-sa", "attribution noncommercial sharealike", 0.8, r"attribution noncommercial sharealike [1-4] [05](?: international| unported)?"),
    ("cc-by-nc-nd", "attribution noncommercial noderivatives", 0.8, r"attribution noncommercial noderivatives [1-4] [05](?: international| unported)?"),
    ("cc-by-nc", "attribution noncommercial", 0.8, r"attribution noncommercial [1-4] [05](?: international| unported)?"),
    ("cc-by-sa", "attribution sharealike", 0.8, r"attribution sharealike [1-4] [05](?: international| unported)?"),
    ("cc-by-nd", "attribution noderivatives", 0.8, r"attribution noderivatives [1-4] [05](?: international| unported)?"),
    ("public-domain", "release this work", 0.9, r"hereby release this work (?:in|into|to) the public domain"),
    ("public-domain", "no copyright is claimed", 0.8, r"no copyright is claimed"),
    ("public-domain", "work of the united states government", 0.8, r"this is a work of the united states government"),
    ("proprietary", "unauthorized copying of this file", 1.0, r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "proprietary and confidential", 0.9, r"proprietary and confidential"),
    ("proprietary", "may be reproduced", 0.7, r"no part of this (?:publication|document|book|work) may be reproduced"),
    # Addresses of license texts.
    ("gpl-3", "gnu org licenses", 0.8, r"gnu org licenses gpl 3 0"),
    ("gpl-2", "gnu org licenses", 0.8, r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("lgpl-3", "gnu org licenses", 0.8, r"gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", "gnu org licenses", 0.8, r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("agpl-3", "gnu org licenses", 0.8, r"gnu org licenses agpl 3 0"),
    ("gfdl", "gnu org licenses", 0.8, r"gnu org licenses fdl(?: 1 [123])?"),
    ("mit", "opensource org licenses mit", 0.9, r"opensource org licenses mit(?: license)?"),
    ("bsd-3-clause", "opensource org licenses bsd", 0.9, r"opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", "opensource org licenses bsd", 0.9, r"opensource org licenses bsd 2 clause"),
    ("isc", "opensource org licenses isc", 0.9, r"opensource org licenses isc"),
    ("mpl-2", "mozilla org mpl 2 0", 0.9, r"mozilla org mpl 2 0"),
    ("epl-2", "eclipse org legal epl", 0.9, r"eclipse org legal epl v?2 ?0"),
    ("epl-1", "eclipse org legal epl", 0.9, r"eclipse org legal epl v1 ?0"),
    ("unlicense", "unlicense org", 0.9, r"unlicense org"),
    ("boost-1", "boost org license 1 0", 0.9, r"(?:www )?boost org license 1 0"),
    ("wtfpl", "wtfpl net", 0.9, r"(?:www )?wtfpl net"),
    ("ofl-1.1", "scripts sil org ofl", 0.9, r"scripts sil org ofl"),
    ("json", "json org license", 0.9, r"json org license"),
    ("odbl-1", "opendatacommons org licenses", 0.8, r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", "opendatacommons org licenses", 0.8, r"opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1", "opendatacommons org licenses", 0.8, r"opendatacommons org licenses pddl(?: 1 0)?"),
]

#: Words of which every place of a statement holds one: those of releases, and those of the other kinds.
RELEASES = ("released under ", "distributed under ", "published under ", "available under ", "provided under ")
AROUND = {kind: RELEASES if kind == "release" else ("licen",) for kind, _, _ in STATEMENTS}


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    weight: float
    pattern: str
    around: tuple[str, ...]  # empty for a rule that stands alone


def rules() -> list[Rule]:
    """All rules in order of priority: stand-alone notices, then each statement with each name."""
    found = [(label, keyword, weight, pattern, ()) for label, keyword, weight, pattern in NOTICES]
    found += [(label, keyword, weight, around.format(name), AROUND[kind]) for kind, weight, around in STATEMENTS for label, keyword, name in NAMES]
    return [Rule(k, label, keyword, weight, rf"(?<![^ ]){pattern}(?![^ ])", around) for k, (label, keyword, weight, pattern, around) in enumerate(found)]


def _held(around: tuple[str, ...]) -> str:
    return "release" if around == RELEASES else "license" if around else ""


def _rule_array(of: list[Rule]) -> str:
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    groups: dict[tuple[str, tuple[str, ...]], list[Rule]] = {}
    for r in of:
        groups.setdefault((r.keyword, r.around), []).append(r)
    listed = [
        f"named_struct('keywords', array({', '.join(map(quote, k.split('|')))}), 'around', {quote(_held(around))}, 'rules', array({', '.join(f'named_struct({chr(39)}p{chr(39)}, {r.priority}, {chr(39)}l{chr(39)}, {quote(r.label)}, {chr(39)}w{chr(39)}, {r.weight}D, {chr(39)}x{chr(39)}, {quote(r.pattern)})' for r in v)}))"
        for (k, around), v in groups.items()
    ]
    return f"array({', '.join(listed)})"


#: From a word string s: every place of a rule's pattern as (start, end, priority, label, weight), in characters.
#: Sums over all places run within blocks of BLOCK places and then over the blocks: a single run would copy its list for each place.
BLOCK = 64
_PLACES = """
transform(filter({table}, g -> (g.around = '' OR (g.around = 'license' AND held.license) OR (g.around = 'release' AND held.release)) AND exists(g.keywords, k -> contains({s}, k))), g -> flatten(transform(g.rules, r ->
  flatten(transform(filter(array(zip_with(regexp_extract_all({s}, r.x, 0), split({s}, r.x), (m, gap) -> named_struct('m', length(m), 'gap', length(gap)))), p -> size(p) > 1), p ->
    aggregate(
      transform(sequence(0, (size(p) - 2) div {block}), b -> filter(slice(p, b * {block} + 1, {block}), y -> y.m IS NOT NULL)),
      named_struct('at', 0, 'out', cast(array() AS array<array<struct<s:int,e:int,p:int,l:string,w:double>>>)),
      (acc, part) -> named_struct(
        'at', acc.at + aggregate(part, 0, (t, y) -> t + y.gap + y.m),
        'out', array_append(acc.out, aggregate(
          part,
          named_struct('at', acc.at, 'out', cast(array() AS array<struct<s:int,e:int,p:int,l:string,w:double>>)),
          (i, y) -> named_struct(
            'at', i.at + y.gap + y.m,
            'out', array_append(i.out, named_struct('s', i.at + y.gap, 'e', i.at + y.gap + y.m, 'p', r.p, 'l', r.l, 'w', cast(r.w AS double)))),
          i -> i.out))),
      acc -> flatten(acc.out))
  ))
)))
"""

_KEPT = """
flatten(transform(array(array_sort({d}, (a, b) -> if(a.s <> b.s, a.s - b.s, if(a.e <> b.e, b.e - a.e, a.p - b.p)))), d ->
  aggregate(
    transform(sequence(0, size(d) div {block}), b -> slice(d, b * {block} + 1, {block})),
    array(named_struct('top', -1, 'out', cast(array() AS array<struct<s:int,e:int,p:int,l:string,w:double>>))),
    (acc, part) -> array_append(acc, aggregate(
      part,
      named_struct('top', acc[size(acc) - 1].top, 'out', cast(array() AS array<struct<s:int,e:int,p:int,l:string,w:double>>)),
      (i, y) -> if(y.e > i.top, named_struct('top', y.e, 'out', array_append(i.out, y)), i))),
    acc -> flatten(transform(acc, x -> x.out)))
))
"""


def _base_starts(words: str, phrase: str) -> str:
    parts = phrase.split()
    test = " AND ".join(f"{words}[i + {k}] = '{w}'" for k, w in enumerate(parts))
    return f"filter(sequence(0, size({words}) - {len(parts)}), i -> {test})"


def scan(docs: DataFrame) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, detections, labels and score to docs (text)."""
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score")
    kept = [c for c in docs.columns if c not in made]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    read = docs.select(row, F.translate(F.coalesce("text", F.lit("")), upper, lower).alias("low"))
    read = read.select("row", F.trim(F.regexp_replace("low", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")).alias("s"))
    holds = lambda words: reduce(or_, (F.contains(F.col("s"), F.lit(w)) for w in words))
    alone = [w for r in rules() if not r.around for w in r.keyword.split("|")]
    gate = holds(dict.fromkeys([*alone, *(w for words in AROUND.values() for w in words)]))
    n_words = F.when(F.col("s") == "", F.lit(0)).otherwise(F.length("s") - F.length(F.replace(F.col("s"), F.lit(" "), F.lit(""))) + 1)
    read = read.select("row", n_words.cast("long").alias("n_words"), F.when(gate, F.col("s")).alias("s"))
    has_base = F.lit(False)
    for phrase in BASE_PHRASES.values():
        has_base = has_base | F.contains(F.col("s"), F.lit(phrase))
    read = read.select("row", "n_words", "s", F.when(has_base, F.split("s", " ")).alias("words"))
    base = [
        F.when(F.contains(F.col("s"), F.lit(phrase)), F.expr(f"transform({_base_starts('words', phrase)}, i -> named_struct('i', i, 'l', '{label}'))"))
        for label, phrase in BASE_PHRASES.items()
    ]
    none = "cast(array() AS array<struct<i:int,l:string>>)"
    held = F.struct(holds(AROUND["name"]).alias("license"), holds(RELEASES).alias("release")).alias("held")
    read = read.select("row", "n_words", "s", held, F.flatten(F.array(*(F.coalesce(b, F.expr(none)) for b in base))).alias("base"))
    empty = "cast(array() AS array<struct<s:int,e:int,p:int,l:string,w:double>>)"
    places = F.expr(f"if(s IS NULL, {empty}, flatten({_PLACES.format(table=_rule_array(rules()), s='s', block=BLOCK)}))").alias("places")
    read = read.select("row", "n_words", "base", places).withColumn("detections", F.expr(_KEPT.format(d="places", block=BLOCK)))
    at = F.expr("transform(base, b -> b.i)")
    base_names = F.array_distinct(F.expr("transform(base, b -> b.l)"))
    return read.select(
        *(F.col(f"row.`{c}`").alias(c) for c in kept),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_names), ",").alias("base_labels"),
        F.col("detections"),
        F.array_join(F.array_sort(F.array_union(base_names, F.expr("transform(detections, d -> d.l)"))), ",").alias("labels"),
        F.coalesce(F.array_max(F.expr("transform(detections, d -> d.w)")), F.lit(0.0)).alias("score"),
    )
