"""License scans: ordered signature rules over a text's words, in SQL functions alone.

A rule is a regex over the words joined by single spaces, a label, a keyword, and a rank. Rules are tried in a text that has
their keyword as a word (the prefilter, one set intersection a text). Each detection is an interval of words. One
that lies within the interval of another of at least its rank is suppressed; of equal intervals of one rank the earlier rule
stays. So "mit license" within "released under the mit license" counts once, as the longer statement.

The base phrases are rules too, but their places and labels are returned whatever suppresses them.

A null text is empty: no words, no labels, score 0. Texts of any length are scanned whole. Repeated rows are rows of their
own; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import native_words

#: Phrases whose every place counts, and their labels: fixed values.
BASE = (
    ("gnu general public license", "gpl", "gnu"),
    ("apache license", "apache", "apache"),
    ("cc by", "cc-by", "cc"),
    ("mit license", "mit", "mit"),
)

#: Label, regex for the name, keyword. Keywords are words that every match of the name holds.
NAMES = (
    ("gpl", "gnu general public licen[cs]e", "gnu"),
    ("gpl-2.0", "gnu general public licen[cs]e(?: v| version)? ?2", "gnu"),
    ("gpl-3.0", "gnu general public licen[cs]e(?: v| version)? ?3", "gnu"),
    ("gpl", "gpl(?: licen[cs]e)?", "gpl"),
    ("gpl-2.0", "gpl(?: v ?| version ?| )2(?: 0)?", "gpl"),
    ("gpl-2.0", "gpl2(?: 0)?", "gpl2"),
    ("gpl-2.0", "gplv2", "gplv2"),
    ("gpl-3.0", "gpl(?: v ?| version ?| )3(?: 0)?", "gpl"),
    ("gpl-3.0", "gpl3(?: 0)?", "gpl3"),
    ("gpl-3.0", "gplv3", "gplv3"),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e(?:(?: v| version)? ?[23](?: [01])?)?", "gnu"),
    ("lgpl", "lgpl(?:(?: v ?| version ?| )[23](?: [01])?)?", "lgpl"),
    ("lgpl", "lgpl2(?: [01])?", "lgpl2"),
    ("lgpl", "lgpl3(?: [01])?", "lgpl3"),
    ("agpl-3.0", "gnu affero general public licen[cs]e(?:(?: v| version)? ?3)?", "affero"),
    ("agpl-3.0", "agpl(?:(?: v ?| version ?| )3(?: 0)?)?", "agpl"),
    ("agpl-3.0", "agpl3(?: 0)?", "agpl3"),
    ("gfdl", "gnu free documentation licen[cs]e(?:(?: v| version)? ?1(?: [123])?)?", "gnu"),
    ("gfdl", "gfdl", "gfdl"),
    ("apache", "apache(?: software)? licen[cs]e", "apache"),
    ("apache-1.1", "apache(?: software)? licen[cs]e(?: v| version)? ?1(?: [01])?", "apache"),
    ("apache-2.0", "apache(?: software(?: licen[cs]e)?(?: v| version)? ?| licen[cs]e(?: v| version)? ?| v ?| version ?| )2(?: 0)?", "apache"),
    ("apache-2.0", "apache2(?: 0)?", "apache2"),
    ("mit", "mit(?: x11)? licen[cs]e", "mit"),
    ("mit", "expat licen[cs]e", "expat"),
    ("mit-0", "mit no attribution(?: licen[cs]e)?", "mit"),
    ("x11", "x11 licen[cs]e", "x11"),
    ("isc", "isc licen[cs]e", "isc"),
    ("bsd", "bsd(?: style)? licen[cs]e", "bsd"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[cs]e)?", "bsd"),
    ("bsd-2-clause", "freebsd(?: licen[cs]e)?", "freebsd"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", "bsd"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?", "bsd"),
    ("0bsd", "0bsd(?: licen[cs]e)?", "0bsd"),
    ("0bsd", "zero clause bsd(?: licen[cs]e)?", "zero"),
    ("mpl", "mozilla public licen[cs]e", "mozilla"),
    ("mpl-1.1", "mozilla public licen[cs]e(?: v| version)? ?1(?: [01])?", "mozilla"),
    ("mpl-2.0", "mozilla public licen[cs]e(?: v| version)? ?2(?: 0)?", "mozilla"),
    ("mpl-2.0", "mpl(?: v ?| version ?| )2(?: 0)?", "mpl"),
    ("mpl-2.0", "mpl2(?: 0)?", "mpl2"),
    ("epl", "eclipse public licen[cs]e(?:(?: v| version)? ?[12](?: 0)?)?", "eclipse"),
    ("edl", "eclipse distribution licen[cs]e(?:(?: v| version)? ?1(?: 0)?)?", "eclipse"),
    ("eupl", "european union public licen[cs]e(?:(?: v| version)? ?1(?: [12])?)?", "european"),
    ("eupl", "eupl(?:(?: v ?| version ?| )1(?: [12])?)?", "eupl"),
    ("eupl", "eupl1(?: [12])?", "eupl1"),
    ("cddl", "common development and distribution licen[cs]e(?:(?: v| version)? ?1(?: [01])?)?", "development"),
    ("cddl", "cddl(?:(?: v ?| version ?| )1(?: [01])?)?", "cddl"),
    ("cddl", "cddl1(?: [01])?", "cddl1"),
    ("cpl", "common public licen[cs]e(?:(?: v| version)? ?1(?: 0)?)?", "common"),
    ("ipl", "ibm public licen[cs]e(?:(?: v| version)? ?1(?: 0)?)?", "ibm"),
    ("artistic", "artistic licen[cs]e(?:(?: v| version)? ?[12](?: 0)?)?", "artistic"),
    ("boost", "boost software licen[cs]e(?:(?: v| version)? ?1(?: 0)?)?", "boost"),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    ("libpng", "libpng licen[cs]e", "libpng"),
    ("openssl", "openssl licen[cs]e", "openssl"),
    ("python", "python(?: software foundation)? licen[cs]e(?:(?: v| version)? ?2)?", "python"),
    ("psf", "psf licen[cs]e(?:(?: v| version)? ?2)?", "psf"),
    ("php", "php licen[cs]e(?:(?: v| version)? ?3(?: 01?)?)?", "php"),
    ("ruby", "ruby licen[cs]e", "ruby"),
    ("perl", "same terms as perl(?: itself)?", "perl"),
    ("unlicense", "(?:the )?unlicense", "unlicense"),
    ("unlicense", "(?:the )?unlicence", "unlicence"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "fuck"),
    ("ms-pl", "microsoft public licen[cs]e", "microsoft"),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "microsoft"),
    ("osl", "open software licen[cs]e(?:(?: v| version)? ?3(?: 0)?)?", "open"),
    ("afl", "academic free licen[cs]e(?:(?: v| version)? ?[23](?: [01])?)?", "academic"),
    ("ecl", "educational community licen[cs]e(?:(?: v| version)? ?[12](?: 0)?)?", "educational"),
    ("upl", "universal permissive licen[cs]e", "universal"),
    ("ncsa", "(?:university of illinois )?ncsa open source licen[cs]e", "ncsa"),
    ("w3c", "w3c software(?: notice and)? licen[cs]e", "w3c"),
    ("odbl", "open database licen[cs]e", "database"),
    ("odc-by", "open data commons attribution licen[cs]e", "commons"),
    ("pddl", "public domain dedication and licen[cs]e", "dedication"),
    ("ofl", "sil open font licen[cs]e(?:(?: v| version)? ?1(?: [01])?)?", "sil"),
    ("ofl", "open font licen[cs]e", "font"),
    ("openrail", "(?:creativeml )?openrail(?: [ms])?(?: licen[cs]e)?", "openrail"),
    ("openrail", "(?:creativeml )?open rail(?: [ms])?(?: licen[cs]e)?", "rail"),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0"),
    ("cc0", "creative commons zero(?: v?1(?: 0)?)?", "creative"),
    ("cc-by", "cc by(?: [1234](?: [05])?)?", "cc"),
    ("cc-by-sa", "cc by sa(?: [1234](?: [05])?)?", "cc"),
    ("cc-by-nd", "cc by nd(?: [1234](?: [05])?)?", "cc"),
    ("cc-by-nc", "cc by nc(?: [1234](?: [05])?)?", "cc"),
    ("cc-by-nc-sa", "cc by nc sa(?: [1234](?: [05])?)?", "cc"),
    ("cc-by-nc-nd", "cc by nc nd(?: [1234](?: [05])?)?", "cc"),
    ("cc-by", "creative commons attribution(?: [1234](?: [05])?)?(?: international| unported| generic)?(?: licen[cs]e)?", "creative"),
    ("cc-by-sa", "creative commons attribution share ?alike(?: [1234](?: [05])?)?(?: international| unported| generic)?(?: licen[cs]e)?", "creative"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:s|atives)(?: [1234](?: [05])?)?(?: international| unported| generic)?(?: licen[cs]e)?", "creative"),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: [1234](?: [05])?)?(?: international| unported| generic)?(?: licen[cs]e)?", "creative"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: [1234](?: [05])?)?(?: international| unported| generic)?(?: licen[cs]e)?", "creative"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1234](?: [05])?)?(?: international| unported| generic)?(?: licen[cs]e)?", "creative"),
    ("cc", "creative commons licen[cs]e", "creative"),
    ("aal", "attribution assurance licen[cs]e", "assurance"),
    ("afpl", "aladdin free public licen[cs]e", "aladdin"),
    ("amdplpa", "amd plpa map c licen[cs]e", "plpa"),
    ("apsl", "apple public source licen[cs]e(?:(?: v| version)? ?[12](?: [012])?)?", "apple"),
    ("beerware", "beerware licen[cs]e", "beerware"),
    ("beerware", "beer ware licen[cs]e", "beer"),
    ("bittorrent", "bittorrent open source licen[cs]e(?:(?: v| version)? ?1(?: [01])?)?", "bittorrent"),
    ("blueoak", "blue oak model licen[cs]e(?: 1 0 0)?", "oak"),
    ("bsd-1-clause", "(?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?", "bsd"),
    ("bsd-patent", "bsd 2 clause plus patent(?: licen[cs]e)?", "bsd"),
    ("bsl", "business source licen[cs]e(?:(?: v| version)? ?1(?: [01])?)?", "business"),
    ("caldera", "caldera licen[cs]e", "caldera"),
    ("catosl", "computer associates trusted open source licen[cs]e", "trusted"),
    ("cc-pdm", "creative commons public domain mark(?: 1 0)?", "creative"),
    ("cdla-permissive", "community data licen[cs]e agreement permissive(?:(?: v| version)? ?[12](?: 0)?)?", "community"),
    ("cdla-sharing", "community data licen[cs]e agreement sharing(?:(?: v| version)? ?1(?: 0)?)?", "community"),
    ("cecill", "cecill(?: [bc])?(?: licen[cs]e)?(?:(?: v ?| version ?| )[12](?: [01])?)?", "cecill"),
    ("cern-ohl", "cern open hardware licen[cs]e(?:(?: v| version)? ?[12](?: [012])?)?", "cern"),
    ("cern-ohl", "cern ohl(?: [swp])?(?: [12](?: [012])?)?", "cern"),
    ("clartistic", "clarified artistic licen[cs]e", "clarified"),
    ("clear-bsd", "clear bsd licen[cs]e", "clear"),
    ("commons-clause", "commons clause(?: licen[cs]e)?(?: condition)?(?: v ?1(?: 0)?)?", "commons"),
    ("cpal", "common public attribution licen[cs]e(?:(?: v| version)? ?1(?: 0)?)?", "attribution"),
    ("cpol", "code project open licen[cs]e(?: 1 02)?", "project"),
    ("crossword", "crossword licen[cs]e", "crossword"),
    ("crystalstacker", "crystalstacker licen[cs]e", "crystalstacker"),
    ("cua-opl", "cua office public licen[cs]e", "cua"),
    ("curl", "curl licen[cs]e", "curl"),
    ("d-fsl", "deutsche freie software lizenz", "lizenz"),
    ("dco", "developer(?: s)? certificate of origin(?: 1 1)?", "certificate"),
    ("doc", "doc software licen[cs]e", "doc"),
    ("ecos", "ecos licen[cs]e(?:(?: v| version)? ?2(?: 0)?)?", "ecos"),
    ("efl", "eiffel forum licen[cs]e(?:(?: v| version)? ?[12](?: 0)?)?", "eiffel"),
    ("elastic", "elastic licen[cs]e(?:(?: v| version)? ?2(?: 0)?)?", "elastic"),
    ("entessa", "entessa public licen[cs]e", "entessa"),
    ("erlpl", "erlang public licen[cs]e(?:(?: v| version)? ?1(?: 1)?)?", "erlang"),
    ("eudatagrid", "eu datagrid software licen[cs]e", "datagrid"),
    ("fair", "fair licen[cs]e", "fair"),
    ("frameworx", "frameworx open licen[cs]e(?: 1 0)?", "frameworx"),
    ("freetype", "freetype(?: project)? licen[cs]e", "freetype"),
    ("fsl", "functional source licen[cs]e", "functional"),
    ("gemma", "gemma terms of use", "gemma"),
    ("giftware", "giftware licen[cs]e", "giftware"),
    ("glide", "3dfx glide licen[cs]e", "3dfx"),
    ("gsoap", "gsoap public licen[cs]e(?:(?: v| version)? ?1(?: 3)?)?", "gsoap"),
    ("hippocratic", "hippocratic licen[cs]e(?:(?: v| version)? ?[23](?: [01])?)?", "hippocratic"),
    ("hpnd", "historical permission notice and disclaimer", "historical"),
    ("icu", "icu licen[cs]e", "icu"),
    ("ijg", "independent jpeg group licen[cs]e", "jpeg"),
    ("imagemagick", "imagemagick licen[cs]e", "imagemagick"),
    ("info-zip", "info zip licen[cs]e", "info"),
    ("intel", "intel open source licen[cs]e", "intel"),
    ("interbase", "interbase public licen[cs]e(?:(?: v| version)? ?1(?: 0)?)?", "interbase"),
    ("ipa", "ipa font licen[cs]e", "ipa"),
    ("jasper", "jasper(?: 2 0)? licen[cs]e", "jasper"),
    ("json", "json licen[cs]e", "json"),
    ("lal", "licence art libre(?: 1 [23])?", "libre"),
    ("lal", "free art licen[cs]e(?: 1 [23])?", "art"),
    ("llama", "llama(?: [234](?: [123])?)? community licen[cs]e(?: agreement)?", "llama"),
    ("lppl", "latex project public licen[cs]e(?:(?: v| version)? ?1(?: [0123][ac]?)?)?", "latex"),
    ("lppl", "lppl(?: 1(?: [0123][ac]?)?)?", "lppl"),
    ("lucent", "lucent public licen[cs]e(?:(?: v| version)? ?1(?: 0[0123456789]?)?)?", "lucent"),
    ("miros", "miros licen[cs]e", "miros"),
    ("motosoto", "motosoto open source licen[cs]e", "motosoto"),
    ("mulan", "mulan(?: permissive)?(?: software| psl)?(?: licen[cs]e)?(?: v ?[12])?", "mulan"),
    ("multics", "multics licen[cs]e", "multics"),
    ("nasa", "nasa open source agreement(?: 1 3)?", "nasa"),
    ("naumen", "naumen public licen[cs]e", "naumen"),
    ("netcdf", "netcdf licen[cs]e", "netcdf"),
    ("ngpl", "nethack general public licen[cs]e", "nethack"),
    ("nlod", "norwegian licen[cs]e for open government data", "norwegian"),
    ("nokia", "nokia open source licen[cs]e", "nokia"),
    ("nosl", "netizen open source licen[cs]e", "netizen"),
    ("npl", "netscape public licen[cs]e(?:(?: v| version)? ?1(?: [01])?)?", "netscape"),
    ("npol", "non profit open software licen[cs]e(?: 3 0)?", "profit"),
    ("ntp", "ntp licen[cs]e", "ntp"),
    ("oclc", "oclc research public licen[cs]e(?: 2 0)?", "oclc"),
    ("ogl", "open government licen[cs]e(?:(?: v| version)? ?[123](?: 0)?)?", "government"),
    ("ogtsl", "open group test suite licen[cs]e", "group"),
    ("oldap", "openldap public licen[cs]e(?:(?: v| version)? ?[12](?: [012345678])?)?", "openldap"),
    ("oset", "oset public licen[cs]e(?: 2 1)?", "oset"),
    ("parity", "parity public licen[cs]e(?: [67] 0 0)?", "parity"),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|internal use|free trial|perimeter)(?: licen[cs]e)?(?: 1 0 [01])?", "polyform"),
    ("postgresql", "postgresql licen[cs]e", "postgresql"),
    ("prosperity", "prosperity public licen[cs]e(?: [23] 0 0)?", "prosperity"),
    ("qpl", "q public licen[cs]e(?: 1 0)?", "q"),
    ("realnetworks", "realnetworks public source licen[cs]e(?: 1 0)?", "realnetworks"),
    ("rpl", "reciprocal public licen[cs]e(?: 1 [15])?", "reciprocal"),
    ("ricoh", "ricoh source code public licen[cs]e", "ricoh"),
    ("rsa-md", "rsa message digest licen[cs]e", "rsa"),
    ("saxpath", "saxpath licen[cs]e", "saxpath"),
    ("sgi-b", "sgi free software licen[cs]e b(?: [12](?: [01])?)?", "sgi"),
    ("simpl", "simple public licen[cs]e(?: 2 0)?", "simple"),
    ("sissl", "sun industry standards source licen[cs]e(?: 1 [12])?", "sun"),
    ("sleepycat", "sleepycat(?: software)? licen[cs]e", "sleepycat"),
    ("spl", "sun public licen[cs]e(?: v ?1(?: 0)?)?", "sun"),
    ("sspl", "server side public licen[cs]e(?:(?: v| version)? ?1)?", "server"),
    ("sugarcrm", "sugarcrm public licen[cs]e(?: v ?1(?: 1 3)?)?", "sugarcrm"),
    ("tcl", "tcl tk licen[cs]e", "tcl"),
    ("ucl", "upstream compatibility licen[cs]e(?: v ?1(?: 0)?)?", "upstream"),
    ("unicode", "unicode licen[cs]e(?: agreement)?(?: v ?3)?", "unicode"),
    ("vim", "vim licen[cs]e", "vim"),
    ("vsl", "vovida software licen[cs]e(?: v ?1(?: 0)?)?", "vovida"),
    ("watcom", "sybase open watcom public licen[cs]e(?: 1 0)?", "watcom"),
    ("wxwindows", "wxwindows library licen[cs]e(?: 3 1)?", "wxwindows"),
    ("xerox", "xerox licen[cs]e", "xerox"),
    ("xfree86", "xfree86 licen[cs]e(?: 1 1)?", "xfree86"),
    ("xnet", "x net licen[cs]e", "net"),
    ("ypl", "yahoo public licen[cs]e(?: v ?1(?: [01])?)?", "yahoo"),
    ("zend", "zend licen[cs]e(?: v ?2(?: 0)?)?", "zend"),
    ("zimbra", "zimbra public licen[cs]e(?: v ?1(?: [34])?)?", "zimbra"),
    ("zpl", "zope public licen[cs]e(?:(?: v| version)? ?[12](?: [01])?)?", "zope"),
)

#: Wording around a name, by rising rank: the name alone, a grant under it, an SPDX tag. {} is the name.
WORDING = (
    (1, "(?:the )?{}"),
    (2, "(?:(?:this|the) (?:work|software|program|file|code|text|project|content|document|dataset|library) is )?(?:dual |multi |re)?licen[cs]ed under (?:the terms of )?(?:the |a )?{}"),
    (2, "(?:released|distributed|published|available|provided|offered|shared|redistributed) under (?:the terms of )?(?:the |a )?{}"),
    (3, "spdx licen[cs]e identifier {}(?: or later| only| plus)?"),
)

#: Notices that name no license: label, regex, keyword, rank.
NOTICES = (
    ("public-domain", "(?:released|dedicated|placed|put) (?:in|in ?to|to) the public domain", "domain", 2),
    ("public-domain", "(?:is|are) in the public domain", "domain", 1),
    ("all-rights-reserved", "all rights reserved", "rights", 1),
    ("proprietary", "proprietary and confidential", "proprietary", 1),
    ("proprietary", "unauthorized (?:copying|use|reproduction|distribution)", "unauthorized", 1),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby", 3),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution", 3),
    ("gpl", "this program is free software you can redistribute it and or modify it", "redistribute", 2),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance", 3),
    ("cc", "some rights reserved", "rights", 1),
    ("gpl", "see the gnu general public license for more details", "gnu", 2),
    ("gpl", "you should have received a copy of the gnu general public license", "gnu", 2),
    ("lgpl", "you should have received a copy of the gnu lesser general public license", "gnu", 3),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license", "affero", 3),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial", 3),
    ("warranty", "the software is provided as is without warranty of any kind", "warranty", 1),
    ("warranty", "this software is provided by the copyright holders and contributors as is", "contributors", 1),
    ("bsd-3-clause", "neither the name of (?:the )?(?:copyright holder|author|organization|university|company) nor the names of its contributors", "neither", 3),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising", 3),
    ("apache-2.0", "distributed on an as is basis without warranties or conditions of any kind", "conditions", 2),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 3),
    ("zlib", "altered source versions must be plainly marked as such", "altered", 3),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla", 3),
    ("cc0", "waive all copyright and related or neighboring rights", "waive", 3),
    ("non-commercial", "for non commercial (?:use|purposes) only", "commercial", 1),
    ("no-ai", "may not be used (?:to train|for training) (?:machine learning|artificial intelligence|ai|language) models", "models", 2),
    ("permission-required", "(?:no part of this|this) (?:publication|book|work|material) may (?:not )?be reproduced", "reproduced", 1),
    ("proprietary", "(?:strictly )?confidential and proprietary", "confidential", 1),
    ("proprietary", "licensed material property of", "property", 1),
)

#: How sure a detection of each rank makes that the text states a license.
WEIGHTS = (0.5, 0.6, 0.8, 0.95)


def rules() -> list[tuple[str, str, str, int, int]]:
    """(label, regex, keyword, rank, number), base phrases first; a detection starts and ends at a space that stays outside."""
    found = [(label, phrase, keyword, 0) for phrase, label, keyword in BASE]
    found += [(label, wording.format(f"(?:{name})"), keyword, rank) for rank, wording in WORDING for label, name, keyword in NAMES]
    found += NOTICES
    return [(label, f"(?<= )(?:{regex})(?= )", keyword, rank, k) for k, (label, regex, keyword, rank) in enumerate(found)]


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(spaced: Column, rule: Column) -> Column:
    """The intervals of words [first, last] where the rule matches, with its rank, number and label."""
    between, matches = F.split(spaced, rule["regex"], F.lit(-1)), F.regexp_extract_all(spaced, rule["regex"], F.lit(0))
    steps = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda b, m: F.struct(_spaces(b).alias("before"), _spaces(m).alias("within")))
    none = F.array().cast("array<struct<first:int,last:int,rank:int,rule:int,label:string>>")
    start = F.struct(F.lit(-1).alias("at"), none.alias("found"))

    def step(a: Column, s: Column) -> Column:
        first = a["at"] + s["before"]
        last = first + s["within"]
        one = F.struct(first.alias("first"), last.alias("last"), rule["rank"].alias("rank"), rule["number"].alias("rule"), rule["label"].alias("label"))
        return F.struct(last.alias("at"), F.concat(a["found"], F.array(one)).alias("found"))

    return F.aggregate(steps, start, step)["found"]


def _resolved(found: Column) -> Column:
    """The detections that no other suppresses; sorted by first word, longer and higher ones first, one pass is enough."""
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("back"), (-d["rank"]).alias("under"), d["rule"].alias("rule"), d["label"].alias("label"))))
    none = F.array().cast("array<struct<first:int,last:int,rank:int,rule:int,label:string>>")
    start = F.struct(none.alias("kept"), *(F.lit(-1).alias(f"end{r}") for r in range(4)))

    def step(a: Column, d: Column) -> Column:
        last, rank = -d["back"], -d["under"]
        hidden = F.greatest(*(F.when(rank <= r, a[f"end{r}"]).otherwise(-1) for r in range(4))) >= last
        one = F.struct(d["first"].alias("first"), last.alias("last"), rank.alias("rank"), d["rule"].alias("rule"), d["label"].alias("label"))
        ends = (F.when(rank == r, F.greatest(a[f"end{r}"], last)).otherwise(a[f"end{r}"]).alias(f"end{r}") for r in range(4))
        return F.struct(F.when(hidden, a["kept"]).otherwise(F.concat(a["kept"], F.array(one))).alias("kept"), *ends)

    return F.aggregate(order, start, step)["kept"]


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, base and kept (detections: first, last, rank, rule, label)."""
    listed = rules()
    literal = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(regex).alias("regex"), F.lit(keyword).alias("keyword"), F.lit(rank).alias("rank"), F.lit(k).alias("number")) for label, regex, keyword, rank, k in listed))
    keywords = F.array(*map(F.lit, sorted({r[2] for r in listed})))
    words = docs.select("doc_id", native_words(F.col("text").cast("string")).alias("words"))
    gated = words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect(keywords, "words").alias("present"), "words")
    spaced = gated.select("doc_id", "n_words", "present", F.when(F.size("present") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).alias("spaced"))
    none = F.array().cast("array<struct<first:int,last:int,rank:int,rule:int,label:string>>")
    tried = F.filter(literal, lambda r: F.array_contains("present", r["keyword"]))
    detections = spaced.select("doc_id", "n_words", F.when(F.col("spaced").isNotNull(), F.flatten(F.transform(tried, lambda r: _places(F.col("spaced"), r)))).otherwise(none).alias("found"))
    return detections.select("doc_id", "n_words", F.filter("found", lambda d: d["rule"] < len(BASE)).alias("base"), F.when(F.size("found") > 0, _resolved(F.col("found"))).otherwise(none).alias("kept"))


def summary(found: DataFrame) -> DataFrame:
    """Counts, labels and a score: one less the product of the doubts that the kept detections leave."""
    base = F.array_sort(F.array_distinct(F.transform("base", lambda d: d["label"])))
    every = F.array_sort(F.array_union(base, F.transform("kept", lambda d: d["label"])))
    firsts = F.transform("base", lambda d: d["first"].cast("long"))
    weights = F.array(*map(F.lit, WEIGHTS))
    doubt = F.aggregate("kept", F.lit(1.0), lambda a, d: a * (F.lit(1.0) - F.get(weights, d["rank"])))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), (F.lit(1.0) - doubt).alias("score"))
