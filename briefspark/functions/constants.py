"""Values that fix the results: thresholds, patterns, word lists and texts."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Thresholds.
# ---------------------------------------------------------------------------
SCHEMA_VERSION = "1"
INLINE_CODE_MAX = 1500
FENCED_CODE_MIN = 12
TABLE_KEY_MIN = 12
CANVAS_DOC_MIN = 60
PAGE_NODE_MIN = 20
TOKEN_SET_MIN = 3
LINEAGE_THRESHOLD = 0.5
TABLE_OVERLAP = 0.8
CHUNK_CHARS = 16_000
PREVIEW_CHARS = 200
SLUG_CHARS = 60
VERDICT_NOTE_CHARS = 120

# ---------------------------------------------------------------------------
# Character classes and patterns.  They are written in the
# syntax that java.util.regex and RE2 share.
# ---------------------------------------------------------------------------
BLANK = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
BLANK_IN_LINE = BLANK.replace(r"\n", "")
#: ASCII word boundary; Java's own \b also looks at non-ASCII letters.
EDGE = (
    r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
)
URL_STOP = r"\"'`<>)"
FENCE = r"```([0-9A-Za-z_.+-]*)\n([\s\S]*?)```"
URL = rf"\bhttps?://[^{BLANK}{URL_STOP}]+"
VERBS = "GET|POST|PUT|PATCH|DELETE"
ENDPOINT = rf"\b({VERBS})[{BLANK}]+(/[^{BLANK}{URL_STOP}]+)"
FILE_ENDING = (
    r"\.(?:ts|tsx|js|jsx|py|rb|go|rs|java|kt|c|cpp|h|cs|php"
    r"|swift|sql|json|ya?ml|toml|md|txt|env|sh|html|css|scss)"
)
FILENAME = rf"\b([0-9A-Za-z_./-]+{FILE_ENDING})\b"
CELL = r"[A-Z]{1,3}\$?[0-9]{1,4}"
FORMULA = (
    rf"(?:\b{CELL}[{BLANK}]*=[{BLANK}]*|=[{BLANK}]*){CELL}"
    rf"(?:[{BLANK}]*[-+*/][{BLANK}]*\$?{CELL})+"
)
SANDBOX_FILE = rf"(?:sandbox:)?/mnt/data/([^{BLANK})\"'`\]]+\.[0-9A-Za-z_]{{1,5}})"
SEPARATOR_LINE = rf"[{BLANK}|:-]+"
URL_HOST = r"(?i)^([a-z0-9-]+\.)+[a-z]{2,}\z"
ARTIFACT_TAG = r"<antArtifact\b([^>]*)>([\s\S]*?)</antArtifact>"
IMAGE_URL = r"(?i)\.(png|jpe?g|gif|webp|svg|bmp|avif)(\?|#|\z)"
SANDBOX_PREFIX = r"(?i)^sandbox:"
SANDBOX_DIR = r"/(mnt/user-data|mnt/data|home/claude|tmp)/"
SELF_REFERENCE = (
    r"(?i)\bhandoff tool\b|\bsummary tool\b|\bin (the )?handoff\b"
    r"|\b(now|verbatim|rejected|decided|open)[" + BLANK + r"]+section\b"
    r"|\battach(ment)? list\b|\bundercount(s|ed|ing)?\b|\bextractor\b"
    r"|\bdistiller\b|\bthe handoff\b"
)

# ---------------------------------------------------------------------------
# Word lists and lookup tables.
# ---------------------------------------------------------------------------
BINARY_EXTENSIONS = (
    "pdf doc docx xls xlsx ppt pptx odt ods odp "
    "png jpg jpeg gif bmp webp ico tif tiff heic "
    "mp3 wav ogg flac mp4 mov avi mkv webm "
    "zip tar gz tgz rar 7z bz2 xz exe dll bin "
    "wasm woff woff2 ttf otf"
).split()
CANVAS_EXTENSIONS = {
    "document": "md",
    "code/python": "py",
    "code/javascript": "js",
    "code/typescript": "ts",
    "code/html": "html",
    "code/react": "jsx",
    "code/css": "css",
    "code/sql": "sql",
}
NOISE_BLOCKS = [
    "image",
    "tool_result",
    "web_search_tool_result",
    "knowledge",
    "thinking",
    "redacted_thinking",
]
SEARCH_BLOCKS = ["web_search_tool_result", "tool_result", "knowledge"]
IMAGE_FIELDS = ["image_url", "thumbnail_url", "thumbnail", "image", "img_url"]
VERBATIM_KINDS = ["code", "table", "name", "path", "number", "api", "constraint"]
#: platform, exact hosts, host suffix, pattern of the conversation id
PLATFORMS = [
    ("claude", ["claude.ai"], ".claude.ai", r"/chat/([0-9a-fA-F-]{8,})"),
    ("chatgpt", ["chatgpt.com", "chat.openai.com"], ".chatgpt.com", r"/c/([0-9a-fA-F-]{36})"),
    ("gemini", ["gemini.google.com"], None, r"(?i)/app/([a-z0-9_-]{6,})"),
    ("perplexity", ["perplexity.ai"], ".perplexity.ai", r"/search/([^/?#]+)"),
    ("grok", ["grok.com"], ".grok.com", r"/c/([0-9a-fA-F-]{8,})"),
    ("deepseek", ["chat.deepseek.com"], ".deepseek.com", r"/s/([0-9a-fA-F-]{8,})"),
    ("huggingface", ["huggingface.co"], ".huggingface.co", r"/conversation/([0-9a-fA-F]{24})"),
]
GENERIC_PLATFORM = "generic-dom"
GEMINI_READ_RPC = "hNvQHb"
GEMINI_CARD = "http://googleusercontent.com/card_content"
OUTPUTS_DIR = "/mnt/user-data/outputs/"
HOME_DIR = "/home/claude"

# ---------------------------------------------------------------------------
# Texts that appear in results.
# ---------------------------------------------------------------------------
UNTITLED = "Untitled conversation"
DEFAULT_SLUG = "handoff-brief"
WHY_BINARY_PRESENTED = "final deliverable presented in the chat (binary file), attach it"
WHY_BINARY = "binary file produced in the chat, attach it"
WHY_PRESENTED = "final deliverable presented to the user, attach this file"
WHY_PRODUCED = "produced in the chat, attach the file so the next reader has the original"
WHY_GENERATED = (
    "generated in the previous session; its sandbox path is session-local and will "
    "not exist in a new chat, so regenerate it or attach the saved copy"
)
WHY_REFERENCED = (
    "referred to in the chat but never shown in full, attach the real file so the "
    "next reader sees more than a snippet"
)
WHY_UPLOADED = (
    "you uploaded this to the chat, attach it so the next reader has the original"
)
RESUME_HEADER = (
    "This is the current state of an earlier conversation, handed off so you can "
    'continue it. Do not re-suggest anything under "Rejected", and treat '
    'everything under "Verbatim" as fixed and exact. Start from "Now".'
)
RESUME_FOOTER = "That is the full current state. Continue from here."
#: section -> (heading, separator between items)
SECTIONS = {
    "now": ("Now", ""),
    "decided": ("Decided", "\n"),
    "open": ("Open", "\n"),
    "rejected": ("Rejected (and why)", "\n"),
    "verbatim": ("Verbatim, keep exact", "\n\n"),
    "files": ("Bring these for full context", "\n"),
    "unknown": ("Raw, could not parse (review these)", "\n"),
}
NOTE_NO_CHUNK = "No chunk produced parseable JSON; fell back to deterministic extraction."
NOTE_NO_OBJECT = "No JSON object found in model output."
NOTE_BAD_JSON = "Model output was not valid JSON"


def edged(pattern: str) -> str:
    """The pattern with ASCII word boundaries, for java.util.regex."""
    return pattern.replace(r"\b", EDGE)
