"""Word lists, patterns and labels that results depend on."""

# Extension tags whose contents are wikitext themselves.
PARSABLE_TAGS = [
    "categorytree", "gallery", "imagemap", "includeonly", "indicator", "inputbox", "noinclude", "onlyinclude",
    "poem", "ref", "references", "section",
]

# Extension tags whose contents are opaque.
OPAQUE_TAGS = [
    "ce", "charinsert", "chem", "graph", "hiero", "languages", "mapframe", "maplink", "math", "nowiki",
    "pagelist", "pagequality", "pages", "pre", "score", "source", "syntaxhighlight", "templatedata",
    "templatestyles", "timeline",
]

# HTML element names valid in wikitext.
HTML_TAGS = [
    "s", "ins", "code", "b", "ol", "i", "h5", "th", "dt", "td", "wbr", "div", "big", "p", "small", "h4", "tt",
    "span", "font", "ruby", "h3", "dfn", "rb", "li", "h1", "cite", "dl", "rtc", "em", "q", "h2", "samp",
    "strike", "time", "blockquote", "bdi", "del", "br", "rp", "hr", "abbr", "sub", "u", "kbd", "table", "rt",
    "dd", "var", "ul", "tr", "center", "data", "strong", "mark", "h6", "bdo", "caption", "sup",
]

# Schemes that start a bare external link.
URL_SCHEMES = [
    "bitcoin:", "ftp://", "ftps://", "geo:", "git://", "gopher://", "http://", "https://", "irc://",
    "ircs://", "magnet:", "mailto:", "mms://", "news:", "nntp://", "redis://", "sftp://", "sip:", "sips:",
    "sms:", "ssh://", "svn://", "tel:", "telnet://", "urn:", "worldwind://", "xmpp:",
]

# Magic words that make {{word}} or {{word:...}} a function.
MAGIC_WORDS = [
    "ARTICLEPAGENAME", "ARTICLEPAGENAMEE", "ARTICLESPACE", "ARTICLESPACEE", "BASEPAGENAME", "BASEPAGENAMEE",
    "CASCADINGSOURCES", "CONTENTLANG", "CONTENTLANGUAGE", "CURRENTDAY", "CURRENTDAY2", "CURRENTDAYNAME",
    "CURRENTDOW", "CURRENTHOUR", "CURRENTMONTH", "CURRENTMONTH1", "CURRENTMONTHABBREV", "CURRENTMONTHNAME",
    "CURRENTMONTHNAMEGEN", "CURRENTTIME", "CURRENTTIMESTAMP", "CURRENTVERSION", "CURRENTWEEK", "CURRENTYEAR",
    "DEFAULTCATEGORYSORT", "DEFAULTSORT", "DEFAULTSORTKEY", "DIRECTIONMARK", "DIRMARK", "DISPLAYTITLE",
    "FULLPAGENAME", "FULLPAGENAMEE", "LOCALDAY", "LOCALDAY2", "LOCALDAYNAME", "LOCALDOW", "LOCALHOUR",
    "LOCALMONTH", "LOCALMONTH1", "LOCALMONTHABBREV", "LOCALMONTHNAME", "LOCALMONTHNAMEGEN", "LOCALTIME",
    "LOCALTIMESTAMP", "LOCALWEEK", "LOCALYEAR", "NAMESPACE", "NAMESPACEE", "NAMESPACENUMBER", "NUMBERINGROUP",
    "NUMBEROFACTIVEUSERS", "NUMBEROFADMINS", "NUMBEROFARTICLES", "NUMBEROFEDITS", "NUMBEROFFILES",
    "NUMBEROFPAGES", "NUMBEROFUSERS", "NUMBEROFVIEWS", "NUMINGROUP", "PAGEID", "PAGELANGUAGE", "PAGENAME",
    "PAGENAMEE", "PAGESINCAT", "PAGESINCATEGORY", "PAGESINNAMESPACE", "PAGESINNS", "PAGESIZE",
    "PROTECTIONEXPIRY", "PROTECTIONLEVEL", "REVISIONDAY", "REVISIONDAY2", "REVISIONID", "REVISIONMONTH",
    "REVISIONMONTH1", "REVISIONTIMESTAMP", "REVISIONUSER", "REVISIONYEAR", "ROOTPAGENAME", "ROOTPAGENAMEE",
    "SCRIPTPATH", "SERVER", "SERVERNAME", "SITENAME", "STYLEPATH", "SUBJECTPAGENAME", "SUBJECTPAGENAMEE",
    "SUBJECTSPACE", "SUBJECTSPACEE", "SUBPAGENAME", "SUBPAGENAMEE", "TALKPAGENAME", "TALKPAGENAMEE",
    "TALKSPACE", "TALKSPACEE", "anchorencode", "canonicalurl", "filepath", "formatnum", "fullurl", "gender",
    "grammar", "int", "lc", "lcfirst", "localurl", "msg", "msgnw", "ns", "nse", "padleft", "padright",
    "plural", "raw", "safesubst", "subst", "uc", "ucfirst", "urlencode",
]

# File extensions that make a link an embedded file.
FILE_EXTENSIONS = [
    "bmp", "djvu", "gif", "iff", "jb2", "jp2", "jpc", "jpeg", "jpg", "jpx", "mid", "mka", "mkv", "mp3", "oga",
    "ogg", "ogv", "ogx", "opus", "pdf", "png", "psd", "spx", "stl", "svg", "swc", "swf", "tif", "tiff",
    "wbmp", "webm", "webp", "wmf", "xbm", "xcf",
]

# Substrings that mark a page as needing correction.
ERROR_PATTERNS = [
    "{ES", "ES}", "ES|", "TRANS", "TRANSLIT", "TAXO", "{pronunc", "{estructura",
    "<ref>Separac", "<ref>separac", "{transliter",
    "'''pronun", "'''Pronun", "'''etimol", "'''Etimol", "'''ej", "'''Ej",
    "'''graf", "'''Graf", "'''sinoni", "'''Sinoni", "'''sinóni", "'''Sinóni",
    "'''antoni", "'''Antoni", "'''antóni", "'''Antóni", "'''relac", "'''Relac",
    "'''hip", "'''Hip", "'''hom", "'''Hom", "'''cohip", "'''Cohip", "'''par",
    "'''Par", "'''datac", "'''Datac", "'''uso", "'''Uso", "'''ámbito",
    "'''Ámbito", "'''ambito", "'''Ambito", "'''anagrama", "'''Anagrama",
    "'''transli", "'''Transli", "'''variante", "'''Variante", "'''derivad",
    "'''Derivad", "'''descend", "'''Descend", "'''rima", "'''Rima", "'''audio",
    "'''Audio", ": '''en ", "{{escritura-ja",
]

# Fixed values: (kind, pattern, suggested template).
LABEL_RULES = [
    ("item", "[p|P]ronunciaci.n:", "pron-graf"),
    ("item", "[e|E]timolog.a:", "etimología"),
    ("item", "[e|E]jemplo:", "ejemplo"),
    ("item", "[s|S]in.nimo:", "sinónimo"),
    ("item", "[a|A]nt.nimo:", "antónimo"),
    ("item", "[h|H]iper.nimo:", "hiperónimo"),
    ("item", "[h|H]ip.nimo:", "hipónimo"),
    ("item", "[h|H]ipocor.stico:", "hipocorístico"),
    ("item", "[c|C]ohip.nimo:", "cohipónimo"),
    ("item", "[p|P]ar.nimo:", "parónimo"),
    ("item", "[u|U]so:", "uso"),
    ("item", "[a|A|á|Á]mbito:", "ámbito"),
    ("item", "[a|A]nagrama:", "anagrama"),
    ("item", "[d|D]erivado:", "derivad"),
    ("item", "[d|D]escendiente:", "descendiente"),
    ("text", "[a|A]testiguado desde el siglo ", "datación"),
    ("text", "[v|V]ariante de ", "variante"),
    ("pron", "[g|G]raf.a alternativa", "pron-graf"),
    ("pron", "[t|T]ransliteraci.n", "pron-graf"),
    ("pron", "[g|G]raf.a alternativa", "pron-graf"),
    ("pron", "[r|R]ima", "pron-graf"),
    ("pron", "[a|A]udio", "pron-graf"),
]
# Patterns of a syllable division and of a written-out template prefix.
SYLLABLE_PATTERN = "[s|S]eparaci.n sil.bica:"
TEMPLATE_PREFIX_PATTERN = "[p|P]lantilla:[ \\t]*"

# Correction codes 0..20 in order.
CORRECTION_LABELS = [
    "unificación de múltiples plantillas repetidas",
    "reacomodamiento del orden de las secciones",
    "inserción de secciones faltantes",
    "inserción de plantillas faltantes",
    "inserción de sintaxis de cierre",
    "sustitución de texto por plantillas",
    "sustitución de items por plantillas",
    "eliminación de plantillas inadecuadas",
    "eliminación de comentarios",
    "eliminación del doble punto",
    "eliminación del doble salto de línea",
    "eliminación de títulos inadecuados",
    "eliminación de enlaces inadecuados o redundantes",
    "eliminación de tags inadecuados o redundantes",
    "correcciones ortográficas",
    "correcciones jerárquicas",
    "normalización de enlaces",
    "normalización de títulos",
    "normalización de plantillas",
    "normalización de listas",
    "normalización de tags",
]

# Characters escaped inside nowiki text.
NOWIKI_ESCAPES = {
    "=": "&equals;", "<": "&lt;", ">": "&gt;", "*": "&ast;", "#": "&num;",
    ":": "&colon;", "!": "&excl;", "|": "&vert;", "[": "&lsqb;", "]": "&rsqb;",
    "{": "&lbrace;", "}": "&rbrace;", '"': "&quot;", "'": "&apos;", "_": "&#95;",
}

# Word classes and inflected forms of dictionary entries.
WORD_CLASSES = [
    "sección", "abreviatura", "acrónimo", "adjetivo", "adjetivo cardinal", "adjetivo demostrativo",
    "adjetivo indefinido", "adjetivo indeterminado", "adjetivo interrogativo", "adjetivo numeral",
    "adjetivo ordinal", "adjetivo posesivo", "adjetivo relativo", "adverbio", "adverbio comparativo",
    "adverbio de afirmación", "adverbio de cantidad", "adverbio de duda", "adverbio de lugar",
    "adverbio de modo", "adverbio de negación", "adverbio de orden", "adverbio de tiempo",
    "adverbio demostrativo", "adverbio interrogativo", "adverbio relativo", "afijo", "artículo",
    "artículo determinado", "artículo indeterminado", "circunfijo", "conjunción", "conjunción adversativa",
    "conjunción ilativa", "dígrafo", "expresión", "forma verbal", "interjección", "letra", "locución",
    "locución adjetiva", "locución adverbial", "locución conjuntiva", "locución interjectiva",
    "locución prepositiva", "locución pronominal", "locución sustantiva", "locución verbal", "onomatopeya",
    "partícula", "postposición", "prefijo", "preposición", "preposición de ablativo",
    "preposición de acusativo", "preposición de acusativo o ablativo", "preposición de genitivo", "pronombre",
    "pronombre demostrativo", "pronombre indefinido", "pronombre interrogativo", "pronombre personal",
    "pronombre posesivo", "pronombre relativo", "refrán", "sigla", "sufijo", "sufijo flexivo", "sustantivo",
    "sustantivo ambiguo", "sustantivo animado", "sustantivo común", "sustantivo femenino",
    "sustantivo femenino y masculino", "sustantivo inanimado", "sustantivo masculino", "sustantivo neutro",
    "sustantivo neutro y masculino", "sustantivo propio", "sustantivo propio/pruebas", "símbolo", "verbo",
    "verbo auxiliar", "verbo impersonal", "verbo intransitivo", "verbo modal", "verbo perfectivo",
    "verbo pronominal", "verbo transitivo",
]
INFLECTED_FORMS = ["forma sustantiva", "forma adjetiva", "forma verbal"]
