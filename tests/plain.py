"""The rule analysis as a plain walk over one text, for comparison with the engine: the patterns are shared, nothing else is."""

from __future__ import annotations

import re

from veilwork.functions import patterns, values
from veilwork.operators import references, rules


def _compiled(pattern: str) -> re.Pattern:
    flags = re.match(r"\(\?([iuU]+)\)", pattern)
    body = pattern[flags.end() :] if flags else pattern
    # without its own flag a pattern knows ASCII digits only
    return re.compile(body.replace("(?iu:", "(?i:").replace("(?iuU:", "(?i:"), (re.I if flags and "i" in flags[1] else 0) | (0 if flags and "U" in flags[1] else re.A))


def _luhn(d: str) -> bool:
    return len(d) >= 2 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _valid(category: str, value: str) -> bool:
    d, raw = re.sub("[^0-9]", "", value), re.sub("[^A-Za-z0-9]", "", value).upper()
    if category == "IBAN":
        return 15 <= len(raw) <= 34 and bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]+", raw)) and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1
    if category == "NIR":
        body = raw[:13].replace("2A", "19", 1) if raw[5:7] == "2A" else raw[:13].replace("2B", "18", 1) if raw[5:7] == "2B" else raw[:13]
        return len(raw) == 15 and body.isdigit() and raw[13:].isdigit() and int(raw[13:]) == 97 - int(body) % 97
    if category == "SIRET":
        return len(d) == 14 and (sum(map(int, d)) % 5 == 0 if d.startswith(values.POST_OFFICE) else _luhn(d))
    if category == "SIREN":
        return len(d) == 9 and _luhn(d)
    if category == "CARTE_BANCAIRE":
        return 13 <= len(d) <= 19 and _luhn(d)
    if category == "IP":
        return all(int(p) <= 255 for p in value.split("."))
    return True


def analyse(doc: str) -> tuple[list[tuple], list[tuple]]:
    """(spans, flags) as (start, end, category)."""
    found: list[tuple[int, int, str]] = []
    for rule in rules.RULES:
        for m in _compiled(rule.pattern).finditer(doc):
            a, b = m.span(2 if rule.how == "group" else 0)
            if _valid(rule.category, doc[a:b]):
                found.append((a, b, rule.category))
    announced = dict.fromkeys(m.span(3) for m in _compiled(references.ANNOUNCED).finditer(doc))
    found += [(a, b, "IDENTIFIANT") for a, b in announced]
    for m in _compiled("(?U)" + patterns.TYPED).finditer(doc):
        if re.search("[A-Z]", m[0]) and any(len(g) >= 3 and g.isdigit() for g in re.split("[-/]", m[0])):
            found.append((*m.span(), "IDENTIFIANT"))

    # elements of addresses that touch are one block, if a street or a postcode is among them
    elements = [(*m.span(), True, False) for m in _compiled(patterns.STREET).finditer(doc)] + [(*m.span(), False, False) for m in _compiled(patterns.COMPLEMENT).finditer(doc)]
    elements += [(a, b, True, True) for a, b, c in found if c == "CODE_POSTAL_VILLE"]
    groups: list[list] = []
    for a, b, anchor, post in sorted(elements, key=lambda e: (e[0], -e[1], e[2], e[3])):
        last = groups[-1] if groups else None
        gap = doc[last[1] : a] if last and a > last[1] else ""
        if last and (a <= last[1] or len(gap) <= values.ADDRESS_GAP_MOST and re.fullmatch(patterns.ADDRESS_GAP, gap)):
            last[1], last[2], last[3] = max(last[1], b), last[2] or anchor, last[3] and post
        else:
            groups.append([a, b, anchor, post])
    blocks = [g for g in groups if g[2] and not g[3]]
    found = [s for s in found if not (s[2] == "CODE_POSTAL_VILLE" and any(g[0] <= s[0] and s[1] <= g[1] for g in blocks))]
    for a, b, _, _ in blocks:
        found.append((a, a + len(re.sub(f"{patterns.ADDRESS_TRIM}\\Z", "", doc[a:b])), "ADRESSE"))

    cited = re.compile(rf"(?<!\w)(?i:{values.PUBLIC_TEXTS})[ ]+(?:[nN][°º][ ]*)?(?:[A-Z]\.[ ]*)?\Z")
    found = [s for s in found if not (s[2] == "IDENTIFIANT" and cited.search(doc[: s[0]]))]
    kept: list[tuple] = []
    for s in sorted(found, key=lambda s: (s[0] - s[1], s[0])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    amount = f"(?!(?i:{values.AMOUNT_AFTER}))"
    flags = [(*m.span(), "IDENTIFIANT") for m in re.finditer(patterns.BARE + amount, doc)]
    return sorted(kept), [f for f in flags if all(f[1] <= k[0] or k[1] <= f[0] for k in kept)]


def mask(doc: str, spans: list[tuple]) -> str:
    """The text with codes, numbered by first appearance of what is the same but for separators, case or blanks."""
    seen: dict[str, list] = {}
    out, at = [], 0
    for a, b, category in spans:
        value = doc[a:b]
        key = re.sub(r"[\s.\-]", "", value).upper() if category in values.COMPACT else value.strip().lower() if category == "EMAIL" else " ".join(value.split())
        mine = seen.setdefault(category, [])
        if key not in mine:
            mine.append(key)
        out += [doc[at:a], f"[{category}_{mine.index(key) + 1:03d}]"]
        at = b
    return "".join([*out, doc[at:]])
