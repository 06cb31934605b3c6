"""Fixed values of the search: names, extensions, words and limits that results depend on."""

# Directories that tools generate, and package directories by suffix.
GENERATED = ["node_modules", "__pycache__", "venv", "env", "target", "build", "dist", "DerivedData", "Pods", "Carthage", "memory_deps"]
PACKAGES = [".app", ".framework", ".bundle", ".xcassets"]
# Files that are never read or sent.
SECRET_NAMES = [".env", ".netrc", ".npmrc", ".pypirc", "credentials", "credentials.json", "secrets.json", "secrets.yaml", "id_rsa", "id_ed25519", "authorized_keys", "known_hosts"]
SECRET_EXTENSIONS = [".pem", ".key", ".p12", ".pfx", ".keychain", ".keychain-db"]
# Kinds by extension, the first kind that has it.
KINDS = {
    "document": "pdf txt md markdown rtf doc docx pages ppt pptx key xls xlsx numbers csv tsv odt epub".split(),
    "image": "png jpg jpeg heic gif webp tiff tif bmp svg avif raw dng".split(),
    "code": "swift py js jsx ts tsx json yaml yml toml html css scss c h cpp rs go rb sh zsh sql xml tex ipynb java kt m mm glsl rst ini cfg pot".split(),
    "media": "mp4 mov mkv avi webm m4v mp3 m4a wav aiff flac ogg".split(),
}
KIND_OF = {extension: kind for kind, extensions in reversed(KINDS.items()) for extension in extensions}
# Words that a query drops.
STOP_WORDS = "a an and are at be by can could desktop do file files find folder folders for from i in is it me my of on or please search show some that the these this to was where which with".split()
# Groups of words that stand for each other.
ALIASES = [
    ["resume", "cv", "curriculum", "vitae"], ["rental", "lease", "tenancy"], ["invoice", "billing"], ["presentation", "slides", "deck"],
    ["photo", "photos", "photograph", "image", "images"], ["expenses", "spending", "expenditure"], ["meeting", "minutes"],
]
# Credential patterns, in the order in which they are replaced.
CREDENTIALS = [
    r"sk-[A-Za-z0-9_-]{16,}", r"gh[pousr]_[A-Za-z0-9_]{20,}", r"github_pat_[A-Za-z0-9_]{20,}", r"AKIA[A-Z0-9]{16}",
    r"(?s)-----BEGIN[^\n]*PRIVATE KEY-----.*?-----END[^\n]*PRIVATE KEY-----",
    r"(?im)(?:api[_-]?key|access[_-]?token|client[_-]?secret|password)\s*[=:]\s*[\"']?[^\s\"',;]{6,}",
]
# What replaces a credential; extensions of texts that are read whole, and of documents that are sampled.
REDACTED = "[credential redacted]"
TEXT_EXTENSIONS = [".txt", ".md", ".markdown", ".csv", ".tsv", ".log", ".svg", ".rtf", ""]
SAMPLED_EXTENSIONS = [".pdf", ".docx", ".pptx", ".xlsx", ".odt"]
# Places in the judged set by route, in the order in which routes are served.
QUOTAS = {"name": 32, "content": 48, "context": 24, "preview": 8, "explore": 16}
# Constants of BM25; most results, judged records, records a request, the threshold; characters of texts.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RESULTS, JUDGED, BATCH, THRESHOLD = 500, 128, 32, 0.6
EXCERPT, SNIPPET = 1400, 650
