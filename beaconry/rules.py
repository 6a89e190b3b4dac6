"""Rule tables: plain data, to be read as constants or broadcast as small DataFrames."""

from __future__ import annotations


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


STOP_WORDS = _set(
    "i a an as at be by do he if in is it me my of on or so to us we all and any are but can did for had has her him his how its not one our "
    "she the too two was who why you also been does each from have here into just onto some than that them then they this upon very were "
    "what when whom will with your being could every other their there these those where which whose would should within another itself "
    "whereas whilst without"
)
RECENT_WORDS = _set("dirty edits change edited recent changed changes editing modify touched modified recently uncommitted")
TEST_IDENTS = _set("afterAll afterEach afterall aftereach beforeAll beforeEach beforeall beforeeach describe expect it test")
AUTHORITATIVE = _set("basename-match explicit-file recent-change")
WEAK_SCORE = 5.0

TEST_INTENT = r"(?i)(^|[\s\"-])(fix|bug|spec|test|broken|regress|failing|fails?)"
HISTORY_INTENT = r"(?i)\b(history|introduced(?: by)?|regression|co-?changed|when did|why did)\b"
DOC_INTENT = r"(?i)(docs?|documentation|manual|guide|readme|tutorial|reference)"
SEMANTIC_DOC_INTENT = r"(?i)\b(guide|manual|readme|spec(?:ification)?|api reference|doc(?:umentation|s)?)\b"
_THE = r"(?:the\s+|)"
NEGATIVE = {
    "tests": rf"(?i)(?:ignore|excluding|without|not|no)\s+{_THE}(?:unit\s+|)tests?",
    "production": r"(?i)\bproduction\b",
    "legacy": rf"(?i)without\s+{_THE}legacy",
    "only_config": rf"(?i)\bonly\s+{_THE}config",
    "under": r"(?i)\bunder\s+([-./\w]+)",
}

#: base form -> the irregular forms that stemming misses
IRREGULAR = {
    base: forms.split()
    for base, forms in {
        "be": "been were was", "bring": "brought", "break": "broke", "build": "built", "buy": "bought", "catch": "caught", "choose": "chose", "come": "coming came",
        "cookie": "cookies", "do": "doing did", "drive": "drove", "fall": "fell", "feel": "felt", "fight": "fought", "find": "finding found", "forget": "forgot",
        "get": "getting got", "give": "giving gave", "go": "going went", "grow": "grew", "have": "having had", "hear": "heard", "hide": "hid", "hold": "held",
        "keep": "kept", "know": "knowing knew", "lead": "led", "leave": "left", "lend": "lent", "lose": "losing lost", "make": "making made", "mean": "meant",
        "meet": "met", "pay": "paid", "ride": "rode", "ring": "rang", "rise": "rose", "route": "routes", "run": "running ran", "seek": "sought", "sell": "sold",
        "send": "sending sent", "shake": "shook", "shine": "shone", "shoot": "shot", "sign": "signs signing signed", "sing": "sang", "sink": "sank", "sit": "sat",
        "sleep": "slept", "slide": "slid", "speak": "spoke", "spend": "spent", "stand": "stood", "steal": "stole", "stick": "stuck", "strike": "struck", "swear": "swore",
        "swim": "swam", "swing": "swung", "take": "taking took", "teach": "taught", "tear": "tore", "tell": "told", "think": "thought", "throw": "threw", "value": "values",
        "verify": "verifies verified", "wake": "woke", "wear": "wore", "win": "won", "withdraw": "withdrew", "write": "writing wrote",
    }.items()
}
BASE_OF = {form: base for base, forms in IRREGULAR.items() for form in forms}

#: extension -> language
LANGUAGES = {
    ext: lang
    for lang, exts in {
        "c": "h c", "cpp": "cc hh cpp hpp", "cs": "cs", "go": "go", "java": "java", "js": "cjs mjs jsx js", "kt": "kts kt", "php": "php", "py": "py", "rb": "rb",
        "rs": "rs", "sh": "zsh bash sh", "swift": "swift", "ts": "cts mts tsx ts",
    }.items()
    for ext in exts.split()
}
LINE_ONLY = _set("dart erl ex exs hrl lua m mm pl pm r scala")

_T = r"(^|/)tests?/"
TEST_FILES = {
    "ts": r"\.(spec|test)\.(tsx?|jsx?|[mc]js)$", "js": r"\.(spec|test)\.(tsx?|jsx?|[mc]js)$", "py": rf"{_T}|(^|/)test_.*\.py$", "go": r"_test\.go$",
    "rg": r"(?i)\.(spec|test)_|(^|/)(_test|__tests__|spec|tests?)(/|\.|_)", "java": rf"{_T}|(^|/)(.*Test|Test.*)\.java$", "rb": r"(^|/)(spec|test)/|_(spec|test)\.rb$",
    "rs": rf"{_T}|_test\.(?i:rs)$", "php": rf"{_T}|Test\.php$", "c": rf"{_T}|_test\.c$", "cpp": rf"{_T}|_test\.(cc|cpp)$", "cs": rf"{_T}|Test\.cs$", "kt": rf"{_T}|Test\.kt$",
    "swift": r"(^|/)Tests/|Test\.swift$", "sh": rf"{_T}|_test\.sh$", "lua": rf"{_T}|_test\.lua$", "scala": rf"{_T}|(Spec|Test)\.scala$", "dart": rf"{_T}|_test\.dart$",
}
_CONFIG = r"(?i)env|settings|config"
_JS = r"(^|/)(server|cli|main|index)\.(tsx?|jsx?|[mc]js)$"
ENTRY_FILES = {
    "ts": _JS, "js": _JS, "py": r"(^|/)cmd/|(^|/)(cli|__main__|main)\.py$", "go": r"(^|/)(cmd/|main\.go)", "rg": r"(^|/)(index|app|__main__|cli|main)\.",
    "java": r"(^|/)(App|Application|Main)\.java$", "rb": r"(^|/)(cli|application|app|main)\.rb$", "rs": r"(^|/)(lib|main)\.rs$", "php": r"(^|/)(app|main|index)\.php$",
    "c": r"(^|/)(app|main)\.c$", "cpp": r"(^|/)(app|main)\.(cc|cpp)$", "cs": r"(^|/)(App|Main|Program)\.cs$", "kt": r"(^|/)(Application|App|Main)\.kt$",
    "swift": r"(^|/)(Application|App|main)\.swift$", "sh": r"(^|/)(app|cli|main)\.sh$", "lua": r"(^|/)(init|main)\.lua$", "scala": r"(^|/)(App|Main)\.scala$",
    "dart": r"(^|/)(app|main)\.dart$",
}
CONFIG_FILES = {k: r"\.config\.|(^|/)(env|settings|config)\." if k in ("ts", "js") else _CONFIG for k in ENTRY_FILES}
ENTRY_FUNCTIONS = {k: r"^main$" for k in ENTRY_FILES} | {"ts": r"^(start|server|cli|main)$", "js": r"^(start|server|cli|main)$", "py": r"^(cli|main)$", "rg": r"^(index|app|cli|main)$", "rb": r"^(cli|main)$", "cs": r"^Main$"}
ENTRY_CLASSES = {"ts": r"Server|^App$", "js": r"Server|^App$", "java": r"^(App|Application|Main)$", "cs": r"^(App|Program)$", "kt": r"^(Application|App|Main)$", "scala": r"^(App|Main)$"}
CONFIG_KINDS = {k: ("const",) if k in ("go", "rs", "c", "cpp", "cs") else ("type", "const") if k in ("ts", "js") else ("var", "const") for k in ENTRY_FILES}

PROSE = _set("adoc htm html log markdown md rst txt")
CONVERTIBLE = _set("epub odp ods odt pdf rtf doc docx docm pot pps ppt pptx pptm ppsx ppsm xls xlsb xlsx xlsm")
DEFAULT_IGNORES = ("*.lock", ".DS_Store", ".cache", ".next", "coverage", "target", "build", "dist", "node_modules", ".git")

_Q = "[\"']"
_NAME = "([A-Z][A-Z0-9_]+)"
ENV_PATTERNS = (
    rf"process\.env\.{_NAME}", rf"process\.env\[{_Q}{_NAME}{_Q}\]", rf"os\.Getenv\({_Q}{_NAME}{_Q}\)", rf"os\.getenv\({_Q}{_NAME}{_Q}\)",
    rf"os\.environ(?:\[|\.get)[(]?{_Q}{_NAME}", rf"ENV\[{_Q}{_NAME}{_Q}\]", rf"getenv\({_Q}{_NAME}{_Q}\)", rf"std::env::var\({_Q}{_NAME}{_Q}\)",
)
_KEY = "([a-z0-9_.-]+)"
CONFIG_PATTERNS = (rf"config\.get\({_Q}{_KEY}{_Q}\)", rf"getConfig\({_Q}{_KEY}{_Q}\)", rf"config\[{_Q}{_KEY}{_Q}\]")

EDGE_WEIGHTS = {"test": 0.5, "ref": 0.3, "inherit": 0.7, "implement": 0.7, "import": 0.5, "contain": 0.6, "call": 0.8}
CONFIDENCE = {"exact": 1.0, "resolved": 0.75, "heuristic": 0.5}
SCIP_DEFINITION, SCIP_REFERENCE = 4, 16
