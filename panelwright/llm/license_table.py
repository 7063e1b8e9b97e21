"""The known licences: whole texts from the folder `licenses` beside this file, with their usual titles and variants, and
the one-line notices that stand for a licence.

A file is named by its licence; what follows a plus tells texts of one licence apart. Texts are listed as they stand and
without what follows their terms (how to apply them). CC-BY-SA-4.0 is the one Creative Commons licence, besides CC0, whose
whole text is listed; the others, AGPL-3.0, EPL and Artistic-2.0 are known by their notices."""

from __future__ import annotations

import re
from itertools import product
from pathlib import Path

FOLDER = Path(__file__).parent / "licenses"
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "BSL-1.0": ("Boost Software License",),
}
# Where the terms of a text end; what follows may be left out, and the line itself as well.
ENDS = (r"^\s*END OF TERMS AND CONDITIONS\s*$", r"^\s*Exhibit A - Source Code Form License Notice\s*$")

HOLDERS = (
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"),
    ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"),
    ("AUTHORS AND CONTRIBUTORS", "AUTHORS OR CONTRIBUTORS"),
    ("AUTHOR", "AUTHOR"),
    ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"),
)


def _bsd(text: str) -> list[str]:
    """With and without numbers of the clauses, and with the usual names for who disclaims."""
    whole = " ".join(text.split())
    for first, second in HOLDERS:
        whole = whole.replace(f"BY THE {first} ", "BY THE {0} ").replace(f"SHALL THE {second} ", "SHALL THE {1} ")
    texts = [whole.format(*pair) for pair in HOLDERS]
    return texts + [re.sub(r" [123]\. (?=Redistributions|Neither)", " ", t) for t in texts]


def texts(plain: dict[str, str]) -> list[tuple[str, str]]:
    """(license, text) of whole texts: the given ones and those of the folder, in their variants."""
    rows = list(plain.items())
    for path in sorted(FOLDER.glob("*.txt")):
        name, text = path.stem.split("+")[0], path.read_text(encoding="utf-8")
        if name.startswith("BSD-"):
            body = text[text.index("Redistribution and use") :]
            rows += [(name, t) for t in _bsd(body)]
            continue
        rows.append((name, text))
        for end in ENDS:
            found = re.search(end, text, re.M)
            rows += [(name, text[: found.start()]), (name, text[: found.end()])] if found else []
    grant, notice, disclaimer = plain["MIT"].split("\n")
    rows.append(("MIT-0", grant.replace(", subject to the following conditions:", ".") + "\n" + disclaimer))
    rows.append(("0BSD", re.sub(r", provided that [^\n]*", ".", plain["ISC"])))
    return rows + [(name, f"{title}\n\n{text}") for name, text in rows for title in TITLES.get(name, ())]


def _gnu(name: str, long: str, short: str, versions: tuple[str, ...]) -> dict[str, list[str]]:
    names = {}
    for v in versions:
        n = [f"{long} version {v}", f"{long} ({short}) version {v}", f"version {v} of the {long}", f"GNU {short} version {v}", f"{short} version {v}"]
        glued = f"{short}v{v.removesuffix('.0')}"
        n += [glued, f"GNU {glued}", f"{long} ({glued})", f"{long} version {v} ({glued})"]
        names[f"{name}-{v}"] = [f"{x}{end}" for x in n for end in ("", " license", " only")] + [f"{short}-{v}-only"]
        later = (" or later", " or any later version", ", or (at your option) any later version")
        names[f"{name}-{v}-or-later"] = [f"{x}{end}" for x in n for end in later] + [f"{short}-{v}-or-later"]
    return names


def _creative_commons() -> dict[str, list[str]]:
    words = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    other = {"NonCommercial": "Non-Commercial", "ShareAlike": "Share Alike", "NoDerivatives": "NoDerivs"}
    names = {}
    for kind, v in product(("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"), ("1.0", "2.0", "2.5", "3.0", "4.0")):
        scope = "International" if v == "4.0" else "Unported" if v == "3.0" else "Generic"
        long = "-".join(words[k] for k in kind.split("-"))
        spelled = {long} | {re.sub("|".join(other), lambda m: other[m[0]], long)} | {long.replace(a, b) for a, b in other.items()}
        stems = [f"{c}{x} {v}{s}" for c in ("Creative Commons ", "CC ", "") for x in sorted(spelled) for s in ("", f" {scope}")]
        short = [f"CC {kind} {v}", f"Creative Commons {kind} {v}", f"CC {kind} {v} {scope}"]
        both = [f"{x} ({short[0]})" for x in stems] + [f"{x} License ({short[0]})" for x in stems]
        names[f"CC-{kind}-{v}"] = [x + end for x in stems + short for end in ("", " License", " Public License")] + both
    return names


NAMES: dict[str, list[str]] = {
    "MIT": ["MIT", "MIT License", "MIT (Expat) License", "Expat License", "MIT License (MIT)"],
    "MIT-0": ["MIT-0", "MIT No Attribution License", "MIT No Attribution"],
    "ISC": ["ISC", "ISC License"],
    "0BSD": ["0BSD", "0BSD License", "Zero-Clause BSD License", "BSD Zero Clause License", "BSD 0-Clause License"],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License",
                     'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License",
                     'BSD 3-Clause "New" or "Revised" License'],
    "Apache-2.0": ["Apache License, Version 2.0", 'Apache License, Version 2.0 (the "License")', "Apache 2.0", "Apache 2.0 License", "Apache Software License 2.0",
                   "Apache License, Version 2.0 (Apache-2.0)", 'Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "MPL-1.1": ["Mozilla Public License Version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "MPL 2.0", "Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL-1.0": ["Eclipse Public License version 1.0", "EPL 1.0"],
    "EPL-2.0": ["Eclipse Public License version 2.0", "EPL 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0"],
    "Zlib": ["zlib License", "zlib", "zlib/libpng License"],
    "Unlicense": ["Unlicense", "Unlicense License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "OFL 1.1"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic 2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal",
                "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication", "Creative Commons CC0 1.0 Universal Public Domain Dedication"],
    **{f"GFDL-{v}": [f"GNU Free Documentation License, Version {v}", f"GFDL {v}"] for v in ("1.1", "1.2", "1.3")},
    **_gnu("GPL", "GNU General Public License", "GPL", ("1.0", "2.0", "3.0")),
    **_gnu("LGPL", "GNU Lesser General Public License", "LGPL", ("2.1", "3.0")),
    **_gnu("LGPL", "GNU Library General Public License", "LGPL", ("2.0",)),
    **_gnu("AGPL", "GNU Affero General Public License", "AGPL", ("3.0",)),
    **_creative_commons(),
}


def notices() -> list[tuple[str, str]]:
    """(name, line): each licence named as what something is licensed under, and its SPDX line."""
    rows = [(f"{name} notice", f"Licensed under {x}") for name, listed in NAMES.items() for x in dict.fromkeys([name, *listed])]
    return rows + [(f"{name} notice", f"SPDX-License-Identifier: {name}") for name in NAMES]
