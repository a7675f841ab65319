"""License notices and texts to look for: (id, license, text). Fixed values.

Notices and headers are the parts that documents quote, whole texts are as
their authors publish them. GPL-3.0 shares most of its words with the AGPL,
whose whole text is not held here: a copy of it matches ``gpl-3-text`` and
``agpl-notice``.
"""

from pathlib import Path


def _whole(name: str) -> str:
    return (Path(__file__).parent / "license_files" / f"{name}.txt").read_text(encoding="utf-8")


TEMPLATES = (
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("gpl-notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("apache-header", "Apache-2.0",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
     "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
     "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
     "limitations under the License."),
    ("mit-text", "MIT",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
     "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the Software."),
    ("bsd-conditions", "BSD",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
     "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
     "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc-text", "ISC",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl-header", "GPL",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-header", "MPL-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
     "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mit-warranty", "MIT",
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
     "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
     "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("agpl-notice", "AGPL", "terms of the GNU Affero General Public License"),
    ("lgpl-notice", "LGPL", "terms of the GNU Lesser General Public License"),
    ("apache-text", "Apache-2.0", _whole("Apache-2.0")),
    ("gpl-2-text", "GPL-2.0", _whole("GPL-2")),
    ("gpl-3-text", "GPL-3.0", _whole("GPL-3")),
    ("lgpl-2.1-text", "LGPL-2.1", _whole("LGPL-2.1")),
    ("lgpl-3-text", "LGPL-3.0", _whole("LGPL-3")),
    ("mpl-2-text", "MPL-2.0", _whole("MPL-2.0")),
    ("cc0-text", "CC0-1.0", _whole("CC0-1.0")),
)

#: Notices of fewer than five words, found inside longer texts as runs of their own length.
SHORT_NOTICES = (("all-rights-notice", "All rights reserved", "All rights reserved."),)
