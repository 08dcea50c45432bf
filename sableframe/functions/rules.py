"""Detection rules and label metadata."""

from __future__ import annotations

from dataclasses import dataclass


# The patterns of the eight detectors, in the order in which they run.
PATTERNS = {
    "IPv4": r"(\b25[0-5]|\b2[0-4][0-9]|\b[01]?[0-9][0-9]?)(\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)){3}",
    "IPv6": r"(([0-9a-fA-F]{1,4}:){7,7}[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,7}:|([0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,5}(:[0-9a-fA-F]{1,4}){1,2}|([0-9a-fA-F]{1,4}:){1,4}(:[0-9a-fA-F]{1,4}){1,3}|([0-9a-fA-F]{1,4}:){1,3}(:[0-9a-fA-F]{1,4}){1,4}|([0-9a-fA-F]{1,4}:){1,2}(:[0-9a-fA-F]{1,4}){1,5}|[0-9a-fA-F]{1,4}:((:[0-9a-fA-F]{1,4}){1,6})|:((:[0-9a-fA-F]{1,4}){1,7}|:)|fe80:(:[0-9a-fA-F]{0,4}){0,4}%[0-9a-zA-Z]{1,}|::(ffff(:0{1,4}){0,1}:){0,1}((25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])|([0-9a-fA-F]{1,4}:){1,4}:((25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9]))",
    "PHONE": r"([\+]\d+\s)?[(]?\d+[)]?[-\s\.]?\d+[-\s\.]?[0-9]{4,6}",
    "EMAIL": r"""(?:[a-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*|"(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21\x23-\x5b\x5d-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])*")@(?:(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?|\[(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?|[a-z0-9-]*[a-z0-9]:(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21-\x5a\x53-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])+)\])""",
    "SSN": r"^(?!0{3})(?!6{3})[0-8]\d{2}-(?!0{2})\d{2}-(?!0{4})\d{4}$",
    "MEDICARE": r"([a-z]{0,3})[-\s]?(\d{3})[-\s]?(\d{2})[-\s]?(\d{4})[-\s]?([0-9a-z]{1,3})",
    "VIN": r"\b[(A-H|J-N|P|R-Z|0-9)]{17}\b",
    "URL": r"(((?:http[s]?:\/\/.)?(?:www\.)?)|((?:ftp[s]?:\/\/.)))[-a-zA-Z0-9@%._\+~#=]{2,256}\.[a-z]{2,6}\b(?:[-a-zA-Z0-9@:%_\+.~#?&\/\/=]*)",
}


def _loops(pattern: str) -> str:
    """The e-mail pattern for Java's engine, which keeps a stack frame per step of a repeated group: the same matches by possessive loops.

    A run of the local part, or of a quoted one, can end in one way only, so nothing is lost by never giving it back. All
    beginnings within a run come to the same end, so only the first is tried, or what lies next to the match before.
    """
    local = r"[a-z0-9!#$%&'*+/=?^_`{|}~-]+"
    begins = rf"(?:(?<!{local[:-1]})(?<!{local[:-1]}\.)|\G|(?<=\G\.))"
    label = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
    literal = r"[\x01-\x08\x0b\x0c\x0e-\x1f\x21-\x5a\x53-\x7f]"
    escaped = r"\\[\x01-\x09\x0b\x0c\x0e-\x7f]"
    for plain, looped in (
        (rf"{local}(?:\.{local})*", rf"{begins}{local}+(?:\.{local}+)*+"),
        (rf'|{escaped})*"', rf'|{escaped})*+"'),
        (rf"(?:{label}\.)+{label}", rf"{label}(?:\.{label})++"),
        (rf"(?:{literal}|{escaped})+", rf"{literal}+(?:(?<=\\)[\x09\x20]{literal}*)*"),
    ):
        if pattern.count(plain) != 1:
            raise ValueError("the e-mail pattern has changed")
        pattern = pattern.replace(plain, looped)
    return pattern


#: Patterns as Java's engine is given them, where that differs.
JAVA = {PATTERNS["EMAIL"]: _loops(PATTERNS["EMAIL"])}
#: What a text must hold for a rule to match at all, as a literal (the rule is skipped otherwise).
NEEDS = {"EMAIL": "@", "IPv6": ":", "IPv4": ".", "URL": "."}
# Labels with the word that stands for them and the kind of their suffix.
LABELS = {
    "ORG": ("Company", "str"),
    "LOC": ("Location", "str"),
    "PERSON": ("Person", "str"),
    "IPv4": ("IPv4 Address", "int"),
    "IPv6": ("IPv6 Address", "int"),
    "PHONE": ("Phone Number", "int"),
    "EMAIL": ("Email Address", "int"),
    "SSN": ("Social Security Number", "int"),
    "MEDICARE": ("Medicare Number", "int"),
    "VIN": ("Vehicle Identification Number", "int"),
    "URL": ("URL Address", "int"),
}
# Names that are never treated as organisations of a document.
STOP_NAMES = (
    "IANA", "Internet Assigned Numbers Authority", "HTML", "Hyper Text Markup Language", "MPLS", "Multi - Protocol Label Switching",
    "PSTN", "Public Switched Telecommunications Network", "Simple Mail Transfer Protocol", "SMTP",
)
# Forms of dates, tried in this order as prefixes of a text, and the default form.
DATE_FORMS = (
    (r"\w+\s\d+", "%B %d"),
    (r"\w+\s\d+", "%B %d"),
    (r"\w+\s\d{1,2},\s*\d{4}", "%B %d, %Y"),
    (r"\d{4}\s\w+\s\d{1,2}", "%Y %B %d"),
    (r"\d{1,2}\s\w+\s\d{4}", "%d %B %Y"),
    (r"\d+\s\w+", "%B %d"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"),
    (r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"),
)
DEFAULT_DATE_FORM = "%d/%m/%Y"
# Words that placeholders use for labels.
PLACEHOLDER_WORDS = {
    "ORG": "Organization",
    "LOC": "Location",
    "POST_CODE": "Post office box",
    "ADDR": "Address",
    "PERSON": "Person",
    "DATE": "Date",
}
# Fonts that stand in when no installed font is near a wanted one.
DEFAULT_FONTS = {"normal": "Segoe UI", "italic": "Segoe UI Italic", "bold": "Segoe UI Bold"}
# Advance widths of Helvetica in thousandths of its size, by the characters that share them; others are 556 wide.
WIDTHS = {
    191: "'", 222: "ijl", 260: "|", 278: " !,./:;I[\\]ft", 333: "()-`r", 334: "{}", 355: '"', 389: "*", 469: "^", 500: "Jcksvxyz", 584: "+<=>~", 611: "FTZ",
    667: "&ABEKPSVXY", 722: "CDHNRUw", 778: "GOQ", 833: "Mm", 889: "%", 944: "W", 1015: "@",
}
OTHER_WIDTH = 556
#: A date; the ruler takes every token that holds one.
DATE_RULE = r"\d{1,2}/\d{1,2}/\d{4}"
#: A run of characters that is one token for the date ruler.
DATE_TOKEN = r"[\p{L}\p{N}_/-]+"
#: Stand-ins for a model of named entities: titles before names, forms of companies and kinds of streets after them.
NAME_RULES = {
    "PERSON": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?",
    "ORG": r"\b(?:[A-Z][a-z]+ ){1,4}(?:Ltd|Inc|Corp|LLC|GmbH|Company|University|Bank)\b",
    "LOC": r"\b[A-Z][a-z]+ (?:Street|Road|Lane|Avenue|Square)\b",
}
#: A stand-in for a model of acronyms: words with capitals before their short form in parentheses.
ACRONYM_RULE = r"\b(?:[A-Z][a-z]+ ){1,6}\([A-Z]{2,10}\)"
#: A social security number anywhere in a text; the rule above only takes a whole text.
SSN_INLINE = r"\b[0-8]\d{2}-\d{2}-\d{4}\b"


@dataclass(frozen=True)
class Rule:
    """A label found by a pattern; rules run in the order of ``rank``."""

    rank: int
    label: str
    pattern: str


class RuleBook:
    """The rules of a run; users add their own with :meth:`register`."""

    def __init__(self, patterns: dict[str, str] | None = None):
        self.rules = [Rule(k, label, p) for k, (label, p) in enumerate((PATTERNS if patterns is None else patterns).items())]

    def register(self, label: str, pattern: str) -> Rule:
        """Adds a rule after the others."""
        if not label or not pattern:
            raise ValueError("a rule needs a label and a pattern")
        rule = Rule(len(self.rules), label, pattern)
        self.rules.append(rule)
        return rule
