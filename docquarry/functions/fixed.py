"""Fixed values that decide results.

Word lists, phrase lists, limits and thresholds below have to hold exactly
these values for the operators to give the expected answers. They are plain
data; the rules that use them live in the other modules.
"""

# --- fixed values: stop words of the question route -----------------------
ROUTE_STOPWORDS = """
a about above after again against all am an and any are as at be because been
before being below between both but by can cannot could did do does doing down
during each few for from further had has have having here how i if in into is
it its just me more most no nor not of off on once only or other our out over
own same should so some such than that the their them then there these they
this those through to too under until up very was were what when where which
while who whom why with would you your yours
""".split()

# --- fixed values: stop words of the search tool --------------------------
TOOL_STOPWORDS = """
a about after all also an and any are as at be because been but by can could
did do does doing during each few for from had has have having he her here him
his how i if in into is it its just me more most my no not of on once only or
other our out over own same she should so some such than that the their them
then there these they this those through to too under until up very was we were
what when where which while who whom why will with would you your
""".split()

# --- fixed values: extra stop words of the single-index search ------------
INDEX_EXTRA_STOPWORDS = "listed doctors doctor physician physicians find show get give list".split()
INDEX_STOPWORDS = ROUTE_STOPWORDS + INDEX_EXTRA_STOPWORDS

# --- fixed values: capitalised words that are not claims ------------------
CLAIM_STOPWORDS = """
the this that these those according based summary answer question
context response result results total tier section page source location
citation overview details info information available provided
""".split()

# --- fixed values: file types ----------------------------------------------
CODE_EXTS = [".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".cpp", ".c", ".h", ".rs", ".sh"]
TEXT_EXTS = [".txt", ".md", ".csv", ".json", ".yaml", ".yml", ".sql"]
OFFICE_EXTS = [".pdf", ".docx"]
IMAGE_EXTS = [".png", ".jpg", ".jpeg", ".webp", ".gif"]
VIDEO_EXTS = [".mp4", ".mov", ".mkv", ".webm", ".avi"]
AUDIO_EXTS = [".wav", ".mp3", ".m4a", ".flac", ".ogg"]
ALLOWED_EXTS = OFFICE_EXTS + TEXT_EXTS + CODE_EXTS + IMAGE_EXTS + VIDEO_EXTS + AUDIO_EXTS
DEFAULT_CATEGORY = "general"

# --- fixed values: retrieval limits and thresholds --------------------------
LIST_DEPTH = 60
RRF_K = 60
CANDIDATE_CAP = 20
DEDUP_KEY_CHARS = 200
SIMILARITY_FLOOR = 0.40
TOP_K = 8
RERANK_CHARS = 512
NAME_BOOST = 5.0
INDEX_LIST_DEPTH = 100
INDEX_SEM_FLOOR = 0.10
CONTEXT_BUDGET = 5600
CONTEXT_MIN = 250
CONTEXT_MAX = 700
HISTORY_TURNS = 6
STATUS_KEEP = 50
MAX_ATTEMPTS = 5
ELLIPSIS = "…"

# --- fixed values: chunk sizes ---------------------------------------------
CHUNK_CHARS = 1000
CHUNK_OVERLAP = 200
CODE_MIN_LINES = 30
CODE_MAX_LINES = 80
THREAD_MAX_CHARS = 800
THREAD_PIECE_CHARS = 600

# --- fixed values: answers ---------------------------------------------------
STRICT_REFUSAL = (
    "I don't have that information from the indexed documents. "
    "No relevant content was found that supports an answer."
)
NOT_FOUND_ANSWER = "I cannot find the answer in the provided documents."
ROUTE_REFUSAL = "I don't have that information from the indexed documents"
NO_CONTEXT = "<no context>"

# --- fixed values: refusal phrases ------------------------------------------
REFUSAL_STARTS = [
    "i don't have that",
    "i don't have it",
    "i cannot find",
    "i cannot answer",
    "i'm sorry",
    "i am sorry",
    "sorry, but",
    "the provided context does not",
    "the context does not",
    "no information",
    "no relevant content",
    "i encountered an error",
]
REFUSAL_HEAD_CHARS = 240
REFUSAL_HEAD_PATTERNS = [
    r"i don't have (?:that|it|any)",
    r"i cannot (?:find|answer|provide)",
    r"i'm unable to",
    r"no (?:relevant )?information",
    r"the (?:provided )?context does not (?:contain|include|have|specify)",
    r"sorry.+?not have",
    r"unable to (?:find|provide|answer|determine)",
    r"based solely on this given data",
    r"there is no (?:mention|indication|information)",
    r"not (?:contain|include|have) (?:specific |any )?information",
    r"we cannot (?:determine|find|answer)",
]
EVAL_REFUSAL_PATTERN = (
    r"(?:does not contain|contains no|does not have|do not have|don't have|no information"
    r"|cannot provide an answer|cannot find|cannot answer|cannot determine|cannot provide"
    r"|not contain this specific|does not (?:mention|include|provide|have))"
    r".{0,80}(?:information|mention|answer|data|context|sources?|piece|score|value|details?)"
)
EVAL_HEDGE_PATTERN = r"not contain|no information|cannot|does not have"
FALLBACK_PATTERN = (
    r"cannot find (?:the answer|this)|unable to find|not find the answer|no information|no info"
    r"|don't have information|don't have info|do not have information|do not have info"
    r"|don't have that information|do not have that information|not have information on that"
    r"|not mention|not contain|not provided|does not provide|do not know|don't know"
    r"|no relevant info|cannot find this in|no relevant organizational history"
)

# --- fixed values: question words that ask for an explanation -------------
# (text, needs a word end after it)
EXPLORATORY_WORDS = [
    ("explain", True), ("summarize", True), ("summary", True), ("describe", True),
    ("compare", True), ("difference", False), ("why", True), ("how to", True),
    ("how does", True), ("how do i", True), ("how can i", True), ("tutorial", True),
    ("guide", True), ("walkthrough", True), ("overview", True), ("analyze", True),
    ("evalu", False), ("synthesis", False), ("synthesi", False), ("detail", False),
]
TEMPERATURE = {"factual": 0.0, "exploratory": 0.3}

# --- fixed values: sentence kinds -------------------------------------------
META_PATTERN = (
    r"^(?:based on the (?:information|context|provided|text|document)"
    r"|the (?:context|provided text|text|document) (?:shows|states|mentions|indicates|says|contains)"
    r"|as (?:mentioned|stated|shown|noted) (?:in|above|below|the)"
    r"|(?:looking at|examining|from) the (?:context|provided|text|document)"
    r"|according to the (?:provided|context|text|document)"
    r"|in the (?:context|provided|text|document)"
    r"|from the (?:context|provided|text|document)"
    r"|the provided (?:context|text|information|document))"
)
PLACEHOLDER_NAMES = "Job{s}Title|Company{s}Name|Start{s}Date|End{s}Date|Your{s}Name|Department|Position"
TRANSITION_PATTERN = (
    r"^(?:here (?:is|are)|below (?:is|are|list)|the following (?:is|are)|please|note that|let me know"
    r"|if you (?:need|have|want)|hope this|feel free|in summary|to summarize|overall|firstly|secondly"
    r"|finally|thank you|sure,?{s0}here|as requested)"
)
ABBREVIATIONS = (
    "Dr Mr Mrs Ms MD DO PT PhD St Ave Rd Ste Inc Co vs approx eg ie "
    "Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec"
).split()
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
CURRENCIES = ["INR", "USD", "EUR", "GBP", "Rs", "₹", r"\$", "€", "£"]

# --- fixed values: secrets and identifiers -------------------------------------
CLOUD_KEY_PATTERN = r"(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}"
SECRET_PATTERN = r"(?i)(key|secret|token|password|auth)%s*[:=]%s*['\"][a-zA-Z0-9_\-]{16,}['\"]"
EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9\-.]+"
CLOUD_KEY_TAG = "[REDACTED_AWS_KEY]"
SECRET_TAG = '[REDACTED_SECRET]'
EMAIL_TAG = "[REDACTED_EMAIL]"
TECHNIQUE_PATTERN = r"AML\.T[0-9]+|T[0-9]{4}(?:\.[0-9]{3})?"

# --- fixed values: media routing ----------------------------------------------
HIGH_TEXT_DENSITY = 0.40
LOW_TEXT_DENSITY = 0.20
OCR_CONFIDENCE = 60
CHAR_PIXELS = 150
MIN_DESCRIPTION_WORDS = 20
OCR_LINE_CHARS = 10
OCR_LINE_WORDS = 2
SCANNED_MAX_CHARS = 100
SCANNED_MIN_KB = 100

TOOL_NAMES = ["search_documents", "read_chunk", "list_files", "compare_sections", "summarize_document"]

# --- fixed values: file format ---------------------------------------------------
PERMISSIONS_KEY = "kgf_permissions"  # front-matter block that holds visibility, groups, users
