"""Detection rules: the fixed rule texts and their Java-regex form.

The rule texts below are fixed values: they must equal the behaviour being
matched, so they are stated verbatim in the Python ``re`` dialect they were
written for.  ``java_regex`` turns one into the Java dialect Spark runs, with
three documented changes (word boundary, whitespace class, flags), so that
the JVM finds the same spans as Python's ``re`` would.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the behaviour being matched; do not edit)
# ---------------------------------------------------------------------------
# Basic rules, confidence 0.98, ignore-case, in emission order.
EMAIL_RULE = r'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'
PHONE_RULE = r'\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b'
AADHAAR_RULE = r'\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b'
SSN_RULE = r'\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0{4})\d{4}\b'
CREDIT_CARD_RULE = r'\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})\b'
IP_ADDRESS_RULE = r'\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b'
URL_RULE = r'\b(?:(?:https?://|www\.)[^\s<>()"\']+|(?:linkedin\.com/in|github\.com|x\.com|twitter\.com|facebook\.com|instagram\.com|youtube\.com|medium\.com)/[^\s<>()"\']+)\b'
REGISTRATION_NUMBER_RULE = r'\b\d{8,12}\b'
# Contextual rules, confidence 0.99, ignore-case, the span is capture group 1.
REGISTRATION_CONTEXT_RULE = r'\b(?:reg(?:istration)?\s*(?:no|number)?\s*[:#-]?\s*)([A-Za-z0-9-]{6,24})\b'
PERSON_CONTEXT_RULE = r'\b(?:name|candidate|applicant|student|patient)\s*[:\-]\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b'
PROFILE_HANDLE_RULE = r'\b(?:https?://)?(?:www\.)?(?:linkedin\.com/in|github\.com|x\.com|twitter\.com)/([A-Za-z0-9._-]{3,})\b'
# Leading-name heuristic, case-sensitive, anchored at the window start, 0.90,
# applied whatever the threshold.
LEADING_NAME_RULE = r'^\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b'
# Token shape and blocked words for the person-name check.
NAME_TOKEN_SHAPE = r"[A-Za-z][A-Za-z'-]*"
NAME_BLOCKLIST = (
    "engineering", "science", "computer", "institute", "university",
    "technical", "technologies", "department", "project", "skills",
    "education", "certifications", "assistant", "health", "cloud",
)
BASIC_CONFIDENCE = 0.98
CONTEXT_CONFIDENCE = 0.99
LEADING_NAME_CONFIDENCE = 0.90
DEFAULT_THRESHOLD = 0.85
SERVICE_THRESHOLD = 0.93
MINIMAL_PROFILE_CONFIDENCE = 0.95
SOURCE_RULES = "rule-based"
SOURCE_MODEL = "statistical"
# ---------------------------------------------------------------------------

# Python's ``\b`` is the edge of a run of letters, numbers and ``_`` (Unicode);
# Java's ``\b`` differs on some rare characters, so the boundary is spelled out.
WORD = r"[\p{L}\p{N}_]"
WB = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
# Python's ``\s`` also covers U+001C..U+001F, which Java's (?U)\s does not.
PY_SPACE_EXTRA = r"\x1c-\x1f"
# Non-ASCII letters that match ASCII letters under ignore-case (see ``Rule.java``).
FOLDS_TO_ASCII = r"\x{131}\x{130}\x{17f}\x{212a}"


def java_regex(py_pattern: str, ignore_case: bool) -> str:
    """Java form of a Python ``re`` pattern (the constructs used above).

    ``\\b`` becomes ``WB``; ``\\s`` gains U+001C..U+001F (inside and outside
    character classes); ``(?U)`` makes ``\\d``/``\\s`` Unicode-aware as in
    Python 3, and ``(?i)`` with ``(?U)`` folds case the way ``re.IGNORECASE``
    does (``ſ``, ``ı``, ``İ`` and the Kelvin sign included).
    """
    out = []
    in_class = False
    class_start = 0
    i = 0
    while i < len(py_pattern):
        ch = py_pattern[i]
        if ch == "\\" and i + 1 < len(py_pattern):
            nxt = py_pattern[i + 1]
            if nxt == "b" and not in_class:
                out.append(WB)
            elif nxt == "s":
                out.append(r"\s" + PY_SPACE_EXTRA if in_class else rf"[\s{PY_SPACE_EXTRA}]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            class_start = len(out)
        elif ch == "]" and in_class and out and out[-1] not in ("[", "[^"):
            in_class = False
            body = "".join(out[class_start:])
            if ignore_case and not body.startswith("[^") and ("A-Z" in body or "a-z" in body):
                # Python's ignore-case ranges also take the four letters that fold
                # to ASCII; Java's (?iU)[A-Z] misses two of them.  Put first in the
                # class, where no "-" can turn them into a range.
                out.insert(class_start + 1, FOLDS_TO_ASCII)
        out.append(ch)
        i += 1
    flags = "(?iU)" if ignore_case else "(?U)"
    return flags + "".join(out)


def leading_boundary(first: str, ignore_case: bool) -> str:
    """``\\b`` in front of a character of the class ``first``.

    Before a word character it asks that none stands in front, before any
    other that one does, so each case needs one look-behind.  The class is
    tested first, case-sensitively and with its ASCII characters listed one by
    one: Java looks those up in a bit table, where a folded range costs several
    calls at every position of the text.  What it tests beyond ASCII is a superset
    (decimal digits; the letters around those of ``FOLDS_TO_ASCII``).
    """
    inner = first[1:-1] if first.startswith("[") else first
    unicode_digits = r"\d" in inner
    inner = inner.replace(r"\d", "0-9")
    chars = set()
    for m in re.finditer(r"\\(?P<escaped>.)|(?P<low>[^\\])-(?P<high>[^\\])|.", inner):
        low, high = m["low"] or m["escaped"] or m[0], m["high"] or m["escaped"] or m[0]
        chars.update(map(chr, range(ord(low), ord(high) + 1)))
    if ignore_case:
        chars |= {c.lower() for c in chars} | {c.upper() for c in chars}
    word = "".join(sorted(c for c in chars if c.isalnum() or c == "_"))
    other = "".join(rf"\{c}" for c in sorted(chars - set(word)))
    beyond = (r"\p{Nd}" if unicode_digits else "") + (r"\x{130}-\x{17f}\x{212a}" if ignore_case and any(c.isalpha() for c in word) else "")
    at_word = rf"(?=(?-i:[{word}{beyond}]))(?<!{WORD})"
    return rf"(?:{at_word}|(?=[{other}])(?<={WORD}))" if other else at_word


@dataclass(frozen=True)
class Rule:
    """One span detector.

    ``group`` 1 means the span is capture group 1, which in every rule ends
    where the match ends.  ``guard`` is a Java regex that every text holding a
    match must contain; it lets the plan skip the full pattern cheaply.
    """

    name: str
    entity_type: str
    pattern: str
    confidence: float
    rank: int
    group: int = 0
    ignore_case: bool = True
    guard: str | None = None
    name_check: bool = False
    anchored: bool = False
    obeys_threshold: bool = True
    source: str = SOURCE_RULES
    first: str | None = None
    word_end: bool = False

    @property
    def python(self) -> tuple[str, int]:
        """Pattern and flags for ``re``: the scan form if there is one, else the rule's text."""
        if self.ignore_case and self.pattern in SCAN_FORMS:
            return SCAN_FORMS[self.pattern], 0
        return self.pattern, re.IGNORECASE if self.ignore_case else 0

    @property
    def java(self) -> str:
        """Java form; with ``first`` (a class holding every possible first
        character of a match, under the rule's flags) ``leading_boundary`` stands for
        the leading ``\\b``, so positions that cannot start a match fail on one class
        test.  ``word_end``: a match's last character is one of a word, so the ending
        ``\\b`` only asks that none follows."""
        out = java_regex(self.pattern, self.ignore_case)
        flags, body = out[:out.index(")") + 1], out[out.index(")") + 1:]
        if self.first:
            if not body.startswith(WB):
                raise ValueError(f"{self.name}: a pattern with first characters must begin with \\b")
            rest = body[len(WB):]
            run = re.match(r"(\[[^\]^][^\]]*\])\+(?=@)", rest)
            if run and "@" not in run[1]:  # a run that can't hold the "@" after it never gives a character back
                rest = run[1] + "++" + rest[run.end():]
            body = leading_boundary(self.first, self.ignore_case) + rest
        if self.word_end:
            if not body.endswith(WB):
                raise ValueError(f"{self.name}: a pattern with a word's end must end with \\b")
            body = body[:-len(WB)] + rf"(?!{WORD})"
        return flags + body

    @property
    def java_guard(self) -> str | None:
        if self.guard is None:
            return None
        return ("(?iU)" if self.ignore_case else "(?U)") + self.guard


# Scan forms: the same matches as the rule texts, written for the plan.  Each
# consumes its first character, of a class listed in both cases, before it looks
# at what stands around it: ``re`` then skips to such characters in a tight loop,
# where a leading ``\b`` starts the matcher at every position.  ``(?<!\w.)`` is
# the boundary in front of a word character just consumed.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_LINK_REST = r"[^\s<>()\"']+"
_HANDLE_HOST = r"(?:linkedin\.com/in|github\.com|x\.com|twitter\.com)"
SCAN_FORMS = {
    PHONE_RULE: r"[+(0-9](?:(?<=\w\+)1[-.\s]?\(?[0-9]{3}|(?<=1)(?<!\w.)[-.\s]?\(?[0-9]{3}|(?<=\w\()[0-9]{3}|(?<=[0-9])(?<!\w.)[0-9]{2})"
                    r"\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    AADHAAR_RULE: r"[0-9](?<!\w.)[0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b",
    SSN_RULE: r"\d(?<!\w.)(?<!9)(?:(?<!0)|(?!00))(?:(?<!6)|(?!66))\d{2}-(?!00)\d{2}-(?!0{4})\d{4}\b",
    CREDIT_CARD_RULE: r"[345](?<!\w.)(?:(?<=4)[0-9]{12}(?:[0-9]{3})?|(?<=5)[1-5][0-9]{14}|(?<=3)[47][0-9]{13})\b",
    IP_ADDRESS_RULE: r"[0-9](?<!\w.)(?:[0-9]?|(?<=[01])[0-9]{2}|(?<=2)(?:5[0-5]|[0-4][0-9]))\.(?:" + _OCTET + r"\.){2}" + _OCTET + r"\b",
    URL_RULE: r"[HhWwLlGgXxTtFfIiİıYyMm](?<!\w.)(?i:(?:(?<=h)ttps?://|(?<=w)ww\.)" + _LINK_REST + r"|(?:(?<=l)inkedin\.com/in|(?<=g)ithub\.com|"
                  r"(?<=x)\.com|(?<=t)witter\.com|(?<=f)acebook\.com|(?<=i)nstagram\.com|(?<=y)outube\.com|(?<=m)edium\.com)/" + _LINK_REST + r")\b",
    REGISTRATION_NUMBER_RULE: r"\d(?<!\w.)\d{7,11}\b",
    REGISTRATION_CONTEXT_RULE: r"[Rr](?<!\w.)(?i:eg(?:istration)?\s*(?:no|number)?\s*[:#-]?\s*([A-Za-z0-9-]{6,24}))\b",
    PERSON_CONTEXT_RULE: r"[NnCcAaSsſPp](?<!\w.)(?i:(?:(?<=n)ame|(?<=c)andidate|(?<=a)pplicant|(?<=s)tudent|(?<=p)atient)"
                             r"\s*[:\-]\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}))\b",
    PROFILE_HANDLE_RULE: r"[HhWwLlGgXxTt](?<!\w.)(?i:(?:(?<=h)ttps?://(?:www\.)?" + _HANDLE_HOST + r"|(?<=w)ww\." + _HANDLE_HOST
                             + r"|(?<=l)inkedin\.com/in|(?<=g)ithub\.com|(?<=x)\.com|(?<=t)witter\.com)/([A-Za-z0-9._-]{3,}))\b",
}

# Guards: necessary sub-patterns, written for the plan (not part of the rules).
# First: every character a match can start with (the leading boundary
# constrains nothing more), likewise written for the plan.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("detect_email", "EMAIL", EMAIL_RULE, BASIC_CONFIDENCE, 0, guard="@", first=r"[A-Za-z0-9._%+\-]"),
    Rule("detect_phone", "PHONE", PHONE_RULE, BASIC_CONFIDENCE, 1, guard="[0-9]{4}", first=r"[+(0-9]", word_end=True),
    Rule("detect_aadhaar", "AADHAAR", AADHAAR_RULE, BASIC_CONFIDENCE, 2, guard="[0-9]{4}", first="[0-9]", word_end=True),
    Rule("detect_ssn", "SSN", SSN_RULE, BASIC_CONFIDENCE, 3, guard=r"\d{3}-\d{2}-\d{4}", first=r"\d", word_end=True),
    Rule("detect_credit_card", "CREDIT_CARD", CREDIT_CARD_RULE, BASIC_CONFIDENCE, 4, guard="[0-9]{13}",
         first="[345]", word_end=True),
    Rule("detect_ip", "IP_ADDRESS", IP_ADDRESS_RULE, BASIC_CONFIDENCE, 5, guard=r"[0-9]\.[0-9]", first="[0-9]", word_end=True),
    Rule("detect_url", "URL", URL_RULE, BASIC_CONFIDENCE, 6, guard=r"https?://|www\.|\.com/",
         first="[hwlgxtfiym]"),
    Rule("detect_registration_number", "REGISTRATION_NUMBER", REGISTRATION_NUMBER_RULE,
         BASIC_CONFIDENCE, 7, guard=r"\d{8}", first=r"\d", word_end=True),
    Rule("detect_registration_context", "REGISTRATION_NUMBER", REGISTRATION_CONTEXT_RULE,
         CONTEXT_CONFIDENCE, 8, group=1, guard="reg", first="r"),
    Rule("detect_person_context", "PERSON_NAME", PERSON_CONTEXT_RULE, CONTEXT_CONFIDENCE, 9,
         group=1, guard=r"(?:name|candidate|applicant|student|patient)[\s\x1c-\x1f]*[:\-]",
         name_check=True, first="[ncasp]", word_end=True),
    Rule("detect_profile_handle", "PROFILE_HANDLE", PROFILE_HANDLE_RULE, CONTEXT_CONFIDENCE, 10,
         group=1, guard=r"\.com/", first="[hwlgxt]"),
    Rule("detect_leading_name", "PERSON_NAME", LEADING_NAME_RULE, LEADING_NAME_CONFIDENCE, 11,
         group=1, ignore_case=False, name_check=True, anchored=True, obeys_threshold=False,
         guard=r"^[\s\x1c-\x1f]*[A-Z][a-z]+[\s\x1c-\x1f]+[A-Z][a-z]"),
)

RULES_BY_NAME = {r.name: r for r in DEFAULT_RULES}

# Fallback profile: e-mail and phone only, case-sensitive, 0.95, no dedup.
MINIMAL_RULES: tuple[Rule, ...] = (
    Rule("detect_email", "EMAIL", EMAIL_RULE, MINIMAL_PROFILE_CONFIDENCE, 0,
         ignore_case=False, guard="@", obeys_threshold=False),
    Rule("detect_phone", "PHONE", PHONE_RULE, MINIMAL_PROFILE_CONFIDENCE, 1,
         ignore_case=False, guard="[0-9]{4}", obeys_threshold=False),
)


def active_rules(threshold: float = SERVICE_THRESHOLD,
                 rules: tuple[Rule, ...] = DEFAULT_RULES) -> tuple[Rule, ...]:
    """Rules that can emit at ``threshold``.

    Rule confidences are constants, so the per-hit threshold test of the
    reference becomes a choice of rules made while the plan is built.
    """
    return tuple(r for r in rules if (not r.obeys_threshold) or r.confidence >= threshold)


def with_guards(rules: tuple[Rule, ...], enabled: bool) -> tuple[Rule, ...]:
    return rules if enabled else tuple(replace(r, guard=None) for r in rules)
