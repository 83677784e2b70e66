"""License scans by template markup.

A template is wording with markup: ``<<beginOptional>> ... <<endOptional>>`` may be left out,
``<<var;most=N>>`` stands for up to N words of any kind. It is compiled into an automaton over
words; a text is accepted where, from some word on, the mandatory wording stands exactly, in
order, with nothing in between but what the markup allows. An automaton is started wherever the
fixed words that open its template stand, so whole texts are searched, not prefixes. A template
holds the whole wording of a license or notice, so one that is altered after its opening is refused.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import small_batches, text_or_empty

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Fixed values. ``{a|b}`` writes a template once for each wording; list marks may be left out.
_MARK = "".join(f"<<beginOptional>>{m}<<endOptional>> " for m in ("and", "{0}", "{1}"))
_LINK = "<<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> <<beginOptional>>www<<endOptional>> "
_ADDRESS = ("<<beginOptional>>Inc<<endOptional>> "
            "<<beginOptional>>51 Franklin {Street|St} <<beginOptional>>Fifth Floor<<endOptional>> Boston, MA 02110-1301<<endOptional>> "
            "<<beginOptional>>59 Temple Place <<beginOptional>>Suite 330<<endOptional>> Boston, MA 02111-1307<<endOptional>> "
            "<<beginOptional>>675 Mass Ave, Cambridge, MA 02139<<endOptional>> <<beginOptional>>USA<<endOptional>>")

_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "<<beginOptional>>associated<<endOptional>> documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice "
        "<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "{NONINFRINGEMENT|NON-INFRINGEMENT}. IN NO EVENT SHALL <<var;most=15>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE")

_BSD_OPENS = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
              "that the following conditions are met: " + _MARK.format(1, "a") +
              "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
              "following disclaimer. " + _MARK.format(2, "b") +
              "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
              "following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_ADVERTISING = ("All advertising materials mentioning features or use of this software must display the following "
                    "acknowledgement: This product includes software developed by <<var;most=20>> ")
_BSD_NAMES = ("{Neither the name of <<var;most=20>> nor the names of <<var;most=3>> contributors may|"
              "The name of <<var;most=20>> may not} be used to endorse or promote products derived from this software "
              "without specific prior written permission. ")
_BSD_ENDS = ("THIS SOFTWARE IS PROVIDED BY <<var;most=20>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
             "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
             "DISCLAIMED. IN NO EVENT SHALL <<var;most=20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
             "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
             "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
             "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
             "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE")

_ISC_OPENS = ("Permission to use, copy, modify, {and/or|and} distribute this software for any purpose with or without fee "
              "is hereby granted")
_ISC_KEEPS = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_ENDS = (". THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;most=15>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
             "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;most=15>> BE LIABLE "
             "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
             "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
             "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE")

_APACHE = ("{Licensed|to you} under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
           "compliance with the License. You may obtain a copy of the License at " + _LINK + "apache.org/licenses/LICENSE-2.0 "
           "Unless required by applicable law or agreed to in writing, software distributed under the License is "
           "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
           "See the License for the specific language governing permissions and limitations under the License")

_MPL_1 = ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use "
          "this file except in compliance with the License. You may obtain a copy of the License at " + _LINK +
          "mozilla.org/MPL Software distributed under the License is distributed on an \"AS IS\" basis, WITHOUT WARRANTY OF "
          "ANY KIND, either express or implied. See the License for the specific language governing rights and "
          "limitations under the License")
_MPL_2 = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
          "distributed with this file, You can obtain one at " + _LINK + "mozilla.org/MPL/2.0")


def _gnu(name: str, version: str) -> str:
    """The notice of a GNU license, from the grant to where the license can be had."""
    of = "" if version == "1" else " of the License"
    return (f"is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of "
            f"the GNU {name} as published by the Free Software Foundation; "
            f"{{either version {version}{of}, or (at your option) any later version|version {version} of the License}}. "
            f"<<var;most=4>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
            f"You should have received a copy of the GNU {name} along with <<var;most=4>> if not, "
            f"{{see {_LINK} gnu.org/licenses|write to the Free Software Foundation {_ADDRESS}}}")


def _forms(text: str) -> list[str]:
    """One template for each choice of its ``{a|b}``, inner ones first."""
    choice = re.search(r"\{([^{}]*)\}", text)
    if not choice:
        return [text]
    return [form for part in choice[1].split("|") for form in _forms(text[:choice.start()] + part + text[choice.end():])]


def _whole(name: str) -> str:
    return pkgutil.get_data(__package__, f"licenses/{name}.txt").decode()


# License names, notices, headers and whole licenses, with markup. Several templates may give one
# label. A whole wording is accepted at its end only; a sentence that names a license has a label of its own.
TEMPLATES = [
    ("mit-notice", "released under the MIT License"),
    ("mit-notice", "licensed under <<beginOptional>>the terms of<<endOptional>> the MIT License"),
    ("apache-2.0", "licensed under the Apache License, <<beginOptional>>Version<<endOptional>> 2.0"),
    ("gpl-3.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, "
                "<<beginOptional>>either<<endOptional>> version 3"
                "<<beginOptional>> or <<var;most=4>> later version<<endOptional>>"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> Creative Commons "
                     "Attribution-NonCommercial 4.0 <<beginOptional>>International<<endOptional>> License"),
] + [(label, form) for label, text in [
    ("mit-text", _MIT),
    ("bsd-2-clause-text", _BSD_OPENS + _BSD_ENDS),
    ("bsd-3-clause-text", _BSD_OPENS + _MARK.format(3, "c") + _BSD_NAMES + _BSD_ENDS),
    ("bsd-4-clause-text", _BSD_OPENS + _MARK.format(3, "c") + _BSD_ADVERTISING + _MARK.format(4, "d") + _BSD_NAMES + _BSD_ENDS),
    ("isc-text", _ISC_OPENS + _ISC_KEEPS + _ISC_ENDS),
    ("0bsd-text", _ISC_OPENS + _ISC_ENDS),
    ("apache-2.0-header", _APACHE),
    ("mpl-1.1-notice", _MPL_1),
    ("mpl-2.0-notice", _MPL_2),
    ("gpl-1.0-notice", _gnu("General Public License", "1")),
    ("gpl-2.0-notice", _gnu("General Public License", "2")),
    ("gpl-3.0-notice", _gnu("General Public License", "3")),
    ("lgpl-2.0-notice", _gnu("Library General Public License", "2")),
    ("lgpl-2.1-notice", _gnu("Lesser General Public License", "2.1")),
    ("lgpl-3.0-notice", _gnu("Lesser General Public License", "3")),
    ("agpl-3.0-notice", _gnu("Affero General Public License", "3")),
] for form in _forms(text)] + [(f"{name}-text", _whole(name)) for name in (
    "apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "mpl-1.1", "mpl-2.0")]

LEAD = 16            # words at most that a place must show before an automaton is started there

_SPACE_OUT = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
                   for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, in UTF-8."""
    return text.encode().translate(_SPACE_OUT).split()


class Automaton:
    """Words in, accepted length out. States are positions in the template's list of steps."""

    def __init__(self, template: str):
        self.steps: list[tuple] = []  # (kind, value): word, any (most), skip (to: where the optional region ends)
        open_: list[int] = []
        for token in re.findall(r"<<[^>]*>>|[^<]+", template):
            if token == "<<beginOptional>>":
                open_.append(len(self.steps))
                self.steps.append(("skip", None))
            elif token == "<<endOptional>>":
                self.steps[open_.pop()] = ("skip", len(self.steps))
            elif token.startswith("<<"):
                most = int(re.search(r"most=(\d+)", token)[1])
                begin = len(self.steps)
                self.steps += [step for k in range(most) for step in (("skip", begin + 2 * most), ("any", None))]
            else:
                self.steps += [("word", w) for w in words_of(token)]
        self.end = len(self.steps)
        depth_ends, self.mandatory = [], []
        for i, (kind, value) in enumerate(self.steps):
            depth_ends = [e for e in depth_ends if e > i]
            if kind == "skip":
                depth_ends.append(value)
            elif kind == "word" and not depth_ends:
                self.mandatory.append(i)
        self.lead = []
        for kind, value in self.steps[:LEAD]:
            if kind != "word":
                break
            self.lead.append(value)
        if len(self.lead) < 2:
            raise ValueError("a template must open with two fixed words at least")

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            i = todo.pop()
            if i < self.end and self.steps[i][0] == "skip":
                for j in (i + 1, self.steps[i][1]):
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
        return seen

    def run(self, words: list[bytes], at: int) -> tuple[int, float]:
        """(words of the longest accepted run from ``at`` or 0, largest share of mandatory wording met)."""
        states, longest, furthest, n = self._closed({0}), 0, 0, 0
        while True:
            if self.end in states:
                longest = n
            furthest = max(furthest, *states) if states else furthest
            if not states or at + n >= len(words):
                break
            word, n = words[at + n], n + 1
            states = self._closed({i + 1 for i in states if i < self.end and (
                self.steps[i][0] == "any" or self.steps[i] == ("word", word))})
        met = sum(i < furthest for i in self.mandatory) / len(self.mandatory)
        return longest, 1.0 if longest else min(met, 0.99)


def compiled(templates) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(text)) for label, text in templates]


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers where the phrase's words stand consecutively; ``joined`` has a space before and after each word."""
    out, at, counted, word = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += joined.count(b" ", counted, at)
        counted = at
        out.append(word)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


def scan_text(text: str, machines: list, phrases: list) -> dict:
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base = [(p, label) for phrase, label in phrases for p in _places(joined, phrase)]
    labels, spans, score = {label for _, label in base}, [], 0.5 if base else 0.0
    for label, machine in machines:
        for at in _places(joined, b" ".join(machine.lead)):
            length, share = machine.run(words, at)
            score = max(score, share)
            if length:
                labels.add(label)
                spans.append((label, at, at + length))
    starts = [p for p, _ in base]
    return {"n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None),
            "last_word": max(starts, default=None), "base_labels": ",".join(sorted({x for _, x in base})),
            "labels": ",".join(sorted(labels)), "score": score,
            "spans": [{"label": a, "first": b, "after": c} for a, b, c in sorted(spans)]}


FIELDS = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
          "score double, spans array<struct<label: string, first: bigint, after: bigint>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, phrases=None) -> DataFrame:
    """One row per document: id, the columns of ``FIELDS``.

    ``spans`` are the accepted runs (label, first word, word after the last). ``score`` is 1
    where a template is accepted, else the largest share of a template's mandatory wording that
    an attempt met (below 1), and at least 0.5 where a phrase stands. Null text is empty (no
    words, no labels, score 0). Ids may be null or repeated; other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    found = [(b" ".join(words_of(p)), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(F.col(text_col)).alias("_t"))
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        kind = pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64())])
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
                 "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(kind)}
        machines = compiled(templates)
        for batch in batches:
            out = [scan_text(t, machines, found) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[k] for x in out], v) for k, v in kinds.items())],
                names=["_id", *kinds])

    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {id_type}, {FIELDS}").withColumnRenamed("_id", id_col)
