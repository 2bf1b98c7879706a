"""Fixed values for the Japanese classical-book corpus.

Every one of them is a default for a parameter; other corpora pass their own.
"""

# -- fixed values: patterns ---------------------------------------------------
GRAM_SYMBOLS = r"[ 　\(\)（）\[\]「」『』\.,]"
COMPOUND_RUN = "[一-龠々ァ-ヶー]+"
COMPOUND_END = "譜"
PACKED_CELL = r"^(.+) \((\p{Nd}+)\)"
BRACED_BLOCK = r"(?s)\{.*\}"

# -- fixed values: class test -------------------------------------------------
CLASS_URI = "https://jpsearch.go.jp/term/keyword/楽譜"
CLASS_MARKER = "楽譜"

# -- fixed values: record keys ------------------------------------------------
LABEL_KEY = "rdfs:label"
NAME_KEY = "schema:name"
ABOUT_KEY = "schema:about"
DESCRIPTION_KEYS = ("schema:description", "description")
ID_KEYS = ("id", "@id", "uri", "url")
NO_TITLE = "No Title"
TEXT_DIVIDER = " ||| "

# -- fixed values: URI prefixes, tested in this order -------------------------
URI_PREFIXES = (
    ("http://schema.org/", "schema:"),
    ("http://www.w3.org/2000/01/rdf-schema#", "rdfs:"),
    ("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdf:"),
    ("http://purl.org/dc/terms/", "dct:"),
    ("https://jpsearch.go.jp/term/property/", "jps:"),
    ("http://www.w3.org/2002/07/owl#", "owl:"),
    ("http://www.w3.org/2004/02/skos/core#", "skos:"),
)

# -- fixed values: noise words, words that protect, and the two exceptions ----
NOISE_WORDS = (
    "系譜", "家譜", "世譜", "年譜", "歴譜", "皇譜", "神譜",
    "花譜", "竹譜", "蘭譜", "菊譜", "梅譜", "椿譜", "百合譜", "草木", "菌譜", "蕈譜", "桜譜",
    "画譜", "図譜", "絵譜", "印譜", "額譜", "香譜",
    "碁譜", "将棋", "棋譜",
    "詩譜", "歌譜", "句譜",
    "相撲", "武鑑", "役者",
    "目録", "解題",
    "名譜",
)
SAFE_WORDS = ("楽譜", "琴譜", "笛譜", "三味線", "浄瑠璃", "謡本", "尺八", "工尺", "仮名譜", "歌譜")
NOISE_EXCEPTIONS = (("名譜", "仮名譜"), ("歌譜", "歌譜"))
MANUAL_DROPS = ("系図", "系譜")
PROTECTED_WORDS = "楽譜,音楽,music,score,notation"

# -- fixed values: harvest filters --------------------------------------------
HARVEST_CODES = (
    "http://jla.or.jp/data/ndc#014.7",
    "http://jla.or.jp/data/ndc#186.5",
    "http://jla.or.jp/data/ndc#774.7",
)
HARVEST_CODE_PREFIX = "http://jla.or.jp/data/ndc#76"
HARVEST_TITLE_REGEX = "譜|音楽|樂譜"
HARVEST_TEXT_REGEX = "楽譜|樂譜|音楽"

# -- fixed values: sizes ------------------------------------------------------
GRAM_SIZES = (2, 3, 4, 5)
GRAM_NAMES = {2: "Bi", 3: "Tri", 4: "Tetra", 5: "Penta"}
TOP_GRAMS = 200
MAX_SAMPLES = 10
SUFFIX_SIZES = (2, 3, 4, 5, 6, 7, 8, 9)
TOP_SUFFIXES = 100
TOP_REASONS = 20
TOP_SUBJECTS = 500
ROOT_SIZE = 2
ROOT_EXAMPLES = 5
PAGE_SIZE = 500
REVIEW_SAMPLE = 300
HARVEST_BATCHES = 4
JUDGE_LIMIT = 4036
QUEUE_LIMIT = 1000
NO_PARENT = "(No 2-char parent)"
SEARCH_URL = "https://www.google.com/search?q="
SEARCH_SUFFIX = " とは"
