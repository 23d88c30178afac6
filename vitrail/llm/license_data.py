"""Sentences of published licences, references to them, and the rules that name a licence from its sentences in order."""

from __future__ import annotations

# Sentences of public licence texts and notices, as published, each with its identifier. A colon or a blank line ends
# a sentence as a full stop does.
TEXTS = {
    "mit-title": "The MIT License",
    "mit-title-short": "MIT License",
    "mit-title-spdx": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-title": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "apache-the-license": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-asf": 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-s": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-definitions": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document',
    "apache-licensor": '"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License',
    "apache-copyright": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-copy-s": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl-title": "Mozilla Public License Version 2.0",
    "gpl-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    "lgpl21-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-no-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gpl2-date": "Version 2, June 1991",
    "gpl3-date": "Version 3, 29 June 2007",
    "lgpl21-date": "Version 2.1, February 1999",
    "agpl3-date": "Version 3, 19 November 2007",
    "gpl-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "gpl3-copyleft": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "unlicense-public": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-claim": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc0": "This work is dedicated to the public domain under CC0 1.0",
    "cc0-title": "CC0 1.0 Universal",
    "reserved": "All rights reserved",
}
# Names under which licences are referred to, by their short identifiers.
NAMES = {
    "MIT": ("MIT License", "MIT licence"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0 license"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0 license"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0 license"),
    "Unlicense": ("Unlicense",),
}
# How a reference begins; each name follows each of them.
OPENINGS = ("Licensed under the", "Released under the", "Distributed under the", "Available under the", "This project is licensed under the", "This work is licensed under the", "This software is licensed under the", "This code is released under the")
# Identifiers of a file's machine-readable licence line.
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "Zlib", "BSL-1.0",
)
# Licence and the identifiers that it needs in order; earlier rules come first.
FULL = (
    ("AGPL-3.0-or-later", ("agpl3-or-later", "gpl-no-warranty", "agpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-or-later", "gpl-no-warranty", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl21-or-later", "lgpl-no-warranty", "lgpl-see")),
    ("GPL-3.0-or-later", ("gpl3-or-later", "gpl-no-warranty", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-no-warranty", "gpl-see")),
    ("AGPL-3.0", ("agpl-title", "agpl3-date")),
    ("LGPL-3.0", ("lgpl-title", "gpl3-date")),
    ("LGPL-2.1", ("lgpl-title", "lgpl21-date")),
    ("GPL-3.0", ("gpl-title", "gpl3-date", "gpl-verbatim", "gpl3-copyleft")),
    ("GPL-3.0", ("gpl-title", "gpl3-date")),
    ("GPL-2.0", ("gpl-title", "gpl2-date")),
    ("MIT", ("mit-title-spdx", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-title-short", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-title", "isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-author")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-terms", "apache-definitions", "apache-licensor", "apache-copyright")),
    ("Apache-2.0", ("apache-the-license", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-the-license", "apache-copy-s", "apache-as-is")),
    ("Apache-2.0", ("apache-asf", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-the-license", "apache-copy")),
    ("MPL-2.0", ("mpl-notice", "mpl-copy")),
    ("MPL-2.0", ("mpl-notice", "mpl-copy-s")),
    ("Unlicense", ("unlicense-public", "unlicense-anyone")),
)
SINGLE = {
    "gpl3-or-later": "GPL-3.0-or-later", "gpl3-only": "GPL-3.0-only", "gpl-free": "GPL-2.0-or-later", "gpl2-only": "GPL-2.0-only", "lgpl21-or-later": "LGPL-2.1-or-later", "lgpl3-or-later": "LGPL-3.0-or-later",
    "agpl3-or-later": "AGPL-3.0-or-later", "apache-the-license": "Apache-2.0", "apache-asf": "Apache-2.0", "apache-definitions": "Apache-2.0", "mit-title": "MIT", "mit-title-short": "MIT", "mit-title-spdx": "MIT", "isc-title": "ISC",
    "mpl-notice": "MPL-2.0", "mpl-title": "MPL-2.0", "unlicense-public": "Unlicense", "epl2-notice": "EPL-2.0", "zlib-claim": "Zlib", "boost-title": "BSL-1.0", "wtfpl-title": "WTFPL",
    "cc-by-nc-4": "CC-BY-NC-4.0", "cc-by-sa-4": "CC-BY-SA-4.0", "cc-by-4": "CC-BY-4.0", "cc0": "CC0-1.0", "cc0-title": "CC0-1.0",
}
WEAK = "proprietary"
LAST = (("BSD", ("reserved", "bsd-grant")), ("BSD", ("bsd-grant",)), (WEAK, ("reserved",)))


def sentences() -> dict[str, list[str]]:
    """Identifier to its sentences: the texts above, references by every opening and name, and machine-readable lines."""
    out = {name: [text] for name, text in TEXTS.items()}
    for short, names in NAMES.items():
        out[f"{short.lower()}-reference"] = [f"{opening} {name}" for opening in OPENINGS for name in names]
    for short in SPDX:
        out[f"{short.lower()}-spdx"] = [f"SPDX-License-Identifier: {short}"]
    return out


def rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Full texts before single sentences, references and what says little."""
    single = tuple((name, (sentence,)) for sentence, name in SINGLE.items())
    lines = tuple((short, (f"{short.lower()}-spdx",)) for short in SPDX)
    told = tuple((short, (f"{short.lower()}-reference",)) for short in NAMES)
    return (*FULL, *lines, *single, *told, *LAST)
