"""Notices and texts of known licenses, without copyright lines."""

from __future__ import annotations

# Sentences, header notices and texts by which licenses are told.
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0"""

APACHE_TERMS = """Unless required by applicable law or agreed to in writing, software distributed under the License
is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""

BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

GNU_TERMS = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}
General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your
option) any later version."""

GNU_WARRANTY = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more
details. You should have received a copy of the GNU {kind} General Public License along with this program. If not, see
https://www.gnu.org/licenses/."""

ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""

ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions:"""

MIT_NOTICE = """The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software."""

MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""

ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""

GNU = (
    ("AGPL-3.0", "Affero", "3", "19 November 2007"),
    ("GPL-2.0", "", "2", "June 1991"),
    ("GPL-3.0", "", "3", "29 June 2007"),
    ("LGPL-2.1", "Lesser", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser", "3", "29 June 2007"),
)

CREATIVE_COMMONS = (
    ("CC-BY-4.0", "BY", "Attribution"),
    ("CC-BY-NC-4.0", "BY-NC", "Attribution-NonCommercial"),
    ("CC-BY-NC-ND-4.0", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    ("CC-BY-NC-SA-4.0", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("CC-BY-ND-4.0", "BY-ND", "Attribution-NoDerivatives"),
    ("CC-BY-SA-4.0", "BY-SA", "Attribution-ShareAlike"),
)

TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", f"{APACHE_NOTICE} {APACHE_TERMS}"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-2-Clause", f"{BSD_CONDITIONS} {BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", BSD_NAMES),
    ("BSD-3-Clause", f"{BSD_CONDITIONS} 3. {BSD_NAMES} {BSD_DISCLAIMER}"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("ISC", "Released under the ISC License"),
    ("ISC", ISC_TEXT),
    ("ISC", f"{ISC_TEXT} {ISC_DISCLAIMER}"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", MIT_TEXT),
    ("MIT", f"{MIT_TEXT} {MIT_NOTICE} {MIT_DISCLAIMER}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", MPL_TEXT),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", UNLICENSE_TEXT),
    ("Zlib", ZLIB_TEXT),
    ("proprietary", "All rights reserved"),
    *(
        (name, text.format(kind=kind, version=version, day=day))
        for name, kind, version, day in GNU
        for text in (
            "This work is licensed under the GNU {kind} General Public License, version {version}",
            "GNU {kind} General Public License Version {version}, {day}",
            GNU_TERMS,
            GNU_TERMS + " " + GNU_WARRANTY,
        )
    ),
    *(
        (name, text)
        for name, short, long in CREATIVE_COMMONS
        for text in (
            f"Licensed under CC {short} 4.0",
            f"Creative Commons {long} 4.0 International Public License",
            f"This work is licensed under a Creative Commons {long} 4.0 International License",
        )
    ),
)
