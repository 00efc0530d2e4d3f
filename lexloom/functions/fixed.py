"""Constants that results depend on. They are data, in their natural order, and not derived from anything."""

# Persian digits and the letters that normalisation maps.
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
LATIN_DIGITS = "0123456789"
ARABIC_LETTERS = "يكة"
PERSIAN_LETTERS = "یکه"
ZERO_WIDTH_NON_JOINER = "‌"

# Words before a number in a text, and the suffix of a repeated article.
ARTICLE, PRINCIPLE, NOTE, REPEATED, SINGLE = "ماده", "اصل", "تبصره", "مکرر", "واحده"
RULING_PATTERN = "(?:رأی|رای)\\s*(?:وحدت\\s*رویه\\s*)?(?:شماره\\s*)?([0-9]{2,5})"
RULING_SUPPORT = "(?:رأی|رای|شماره)"

# Pattern of a law's name in a question -> what its title contains; the first that matches counts.
LAW_HINTS = [
    ("قانون اساسی|اساسی جمهوری", "اساسی"),
    ("آیین دادرسی کیفری", "آیین دادرسی کیفری"),
    ("آیین دادرسی مدنی|آ\\.د\\.م", "آیین دادرسی مدنی"),
    ("اجرای احکام مدنی", "اجرای احکام مدنی"),
    ("مسئولیت مدنی", "مسئولیت مدنی"),
    ("مجازات اسلامی|تعزیرات", "مجازات اسلامی"),
    ("قانون مدنی", "قانون مدنی"),
    ("قانون تجارت|تجارت", "تجارت"),
    ("صدور چک|قانون چک", "چک"),
    ("قانون کار(?!شناس)", "کار"),
    ("تأمین اجتماعی|تامین اجتماعی", "تأمین اجتماعی"),
    ("ثبت اسناد|قانون ثبت", "ثبت"),
    ("وکالت", "وکالت"),
    ("دیوان عدالت", "دیوان عدالت"),
    ("حمایت خانواده|خانواده", "خانواده"),
    ("موجر و مستاجر|موجر و مستأجر", "موجر"),
    ("قانون مجازات|کیفر", "مجازات"),
]

# Kinds of binding force and their ranks.
CONSTITUTION, REGULATION_PATTERN = "اساسی", "آیین.?نامه|تصویب.?نامه|نظامنامه"
UNIFIED_RULING_TITLES = ["وحدت رویه", "هیأت عمومی", "هیئت عمومی"]
AUTHORITY = {
    "constitution": ("binding", 100),
    "convention": ("binding_if_valid", 88),
    "regulation": ("binding_if_valid", 70),
    "statute": ("binding", 90),
    "advisory_opinion": ("advisory", 40),
    "terminology": ("doctrine", 20),
    "unified_ruling": ("binding_on_courts", 80),
    "case_law": ("persuasive", 35),
    "other": ("persuasive", 30),
}

# Weights of the fused score and its thresholds.
W_EXACT, W_SEMANTIC, W_LEXICAL, W_AUTHORITY, W_OFFICIAL = 1.35, 0.55, 0.25, 0.12, 0.08
EXACT_PLAIN, EXACT_TITLE, EXACT_OTHER_TITLE, KEEP_SCORE = 0.72, 1.0, 0.35, 0.18

# Topics for which no draft is written.
REFUSED = "تجاوز(?:\\s+جنسی)?|تجاوز به عنف|جرائم? منافی عفت|مواد مخدر|اعتیاد به مواد|قاچاق مواد"
REFUSED_STEMS = "تجاوز|منافی عفت|مواد مخدر|اعتیاد به مواد|قاچاق مواد"
JUDGMENT = "رأی|رای دادگاه|دادنامه|حکم صادر|حکم دادگاه|قرار منع|قرار موقوفی|کیفرخواست صادر"
CRIMINAL_AFTER_JUDGMENT = "کلاه|سرقت|ضرب|جرح|تهدید|توهین|کیفر|دادسرا|متهم"
CRIMINAL_HINT = "کلاه|فریب|سرقت|دزد|تهدید|فحش|کتک|جرح"
BARRED, BY_DEFAULT = "قرار منع|موقوفی", "غیابی"
POST_JUDGMENT_FORMS = ["civil-appeal", "criminal-appeal", "cassation", "retrial", "objection-default", "criminal-default", "bar-prosecution", "third-party-objection", "expert-objection"]

# Text for what is redacted, for an unnamed party and an unnamed case, and for an empty field.
REDACTED, PARTY, CASE, BLANK = "……", "طرف پرونده", "پرونده قضایی (هویت حذف‌شده)", "………………"
PLAINTIFF = "خواهان"
TITLE_PARTIES = ["خواهان/شاكي", "خواهان/شاکی", "خوانده/متهم", "وكيل دادگستري", "وکیل دادگستری"]
PERSONAL_KEYS = ["nationalcode", "identityno", "fullname", "fathername", "birthdate", "mobile", "phone", "tel", "telephone", "email", "address", "postalcode"]
PERSON_KEPT_KEYS = ["role", "persontype", "legaltype", "nationality", "sex"]

# Document kinds in order of rank.
KINDS = ["قانون", "آیین‌نامه", "رأی", "اساسنامه", "دستورالعمل", "تصویب‌نامه", "مصوبه", "بخشنامه", "سایر"]
RULING_KIND = "رأی"

# Fixed values: (kind, what its titles start with, in how many first characters one of the words stands); the first that fits.
KIND_MARKS = [
    ("قانون", ["قانون"], 0, []),
    ("آیین‌نامه", ["آيين", "آیین"], 40, ["آيين‌نامه", "آیین‌نامه"]),
    ("رأی", [], 48, ["دادنامه", "رأي", "رای", "هيأت عمومي", "هیئت عمومی", "هيئت تخصصي", "دیوان عدالت", "ديوان عدالت"]),
    ("اساسنامه", [], 48, ["اساسنامه"]),
    ("دستورالعمل", [], 36, ["دستورالعمل"]),
    ("تصویب‌نامه", ["تصويب", "تصویب"], 40, ["تصويب نامه"]),
    ("مصوبه", [], 24, ["مصوبه"]),
    ("بخشنامه", [], 30, ["بخشنامه"]),
]

# Patterns of a scan's title (in its metadata, at a line's start, near the text's start), of a title among
# breadcrumbs, of a unified ruling's number and of a date.
SCAN_NAME, SCAN_START, SCAN_NEAR = "قانون|لایحه|آیین", "قانون|لایحه قانونی|آیین[\\s‌]*نامه", "((?:قانون|لایحه قانونی)[^\\n.]{4,80})"
CRUMB_NAME, CRUMB_STATUTE, CRUMB_TRAIL = "قانون|رأی|رای|آیین|ماده|وحدت", "^قانون(\\s|$)", "قانون .+> ماده"
UNIFIED_RULING = "رأ[يی]\\s*وحدت[‌\\s]*رویه\\s*شماره\\s*([۰-۹0-9]+(?:\\s*[–\\-]\\s*[۰-۹0-9]+)?)"
UNIFIED_RULING_TITLE = ("رأی وحدت رویه شماره ", " هیأت عمومی")
SOLAR_DATE = "((?:۱۳|۱۴)[۰-۹0-9]{2}(?:[/\\-][۰-۹0-9]{1,2}){0,2})"

# Number words.
ONES = {
    "صفر": 0, "اول": 1, "یکم": 1, "یک": 1, "دوم": 2, "دو": 2, "سوم": 3, "سه": 3, "چهارم": 4, "چهار": 4, "پنجم": 5, "پنج": 5,
    "ششم": 6, "شش": 6, "هفتم": 7, "هفت": 7, "هشتم": 8, "هشت": 8, "نهم": 9, "نه": 9, "دهم": 10, "ده": 10, "یازدهم": 11, "یازده": 11,
    "دوازدهم": 12, "دوازده": 12, "سیزدهم": 13, "سیزده": 13, "چهاردهم": 14, "چهارده": 14, "پانزدهم": 15, "پانزده": 15,
    "شانزدهم": 16, "شانزده": 16, "هفدهم": 17, "هفده": 17, "هجدهم": 18, "هجده": 18, "نوزدهم": 19, "نوزده": 19,
}
TENS = {"بیست": 20, "بیستم": 20, "سی": 30, "سی ام": 30, "چهلم": 40, "چهل": 40, "پنجاه": 50, "پنجاهم": 50, "شصت": 60, "شصتم": 60, "هفتاد": 70, "هفتادم": 70, "هشتاد": 80, "هشتادم": 80, "نود": 90, "نودم": 90}
HUNDREDS = {"صد": 100, "یکصد": 100, "یک صد": 100, "دویست": 200, "سیصد": 300, "چهارصد": 400, "پانصد": 500}

# ISO 3166 codes of three letters and English names -> codes of two.
ISO3 = dict(
    DEU="DE", FRA="FR", ITA="IT", ESP="ES", NLD="NL", AUT="AT", BEL="BE", SWE="SE", DNK="DK", FIN="FI", POL="PL", GRC="GR", PRT="PT", CZE="CZ", HUN="HU", ROU="RO",
    BGR="BG", HRV="HR", SVK="SK", SVN="SI", LTU="LT", LVA="LV", EST="EE", LUX="LU", MLT="MT", CYP="CY", IRL="IE", GBR="GB", CHE="CH", NOR="NO", TUR="TR", RUS="RU",
    UKR="UA", ALB="AL", SRB="RS", AZE="AZ", ARM="AM", GEO="GE", MDA="MD", BIH="BA", MNE="ME", MKD="MK", ISL="IS", LIE="LI", AND="AD", SMR="SM", MCO="MC", USA="US",
)
COUNTRY_NAMES = {
    "germany": "DE", "france": "FR", "italy": "IT", "spain": "ES", "netherlands": "NL", "austria": "AT", "belgium": "BE", "sweden": "SE", "denmark": "DK", "finland": "FI",
    "poland": "PL", "greece": "GR", "portugal": "PT", "czech republic": "CZ", "czechia": "CZ", "hungary": "HU", "romania": "RO", "bulgaria": "BG", "croatia": "HR",
    "slovakia": "SK", "slovenia": "SI", "lithuania": "LT", "latvia": "LV", "estonia": "EE", "luxembourg": "LU", "malta": "MT", "cyprus": "CY", "ireland": "IE",
    "switzerland": "CH", "norway": "NO", "united kingdom": "GB", "turkey": "TR", "türkiye": "TR", "russia": "RU", "serbia": "RS", "albania": "AL", "armenia": "AM", "azerbaijan": "AZ",
}

# Elements of a page that hold no text of their own, elements that end a line, entities in order of replacement.
SILENT_TAGS = ["head", "script", "style", "nav", "header", "footer", "noscript", "iframe", "svg"]
BLOCK_TAGS = ["p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "section", "article"]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]

# Words of a site's name, which go from a title with the dash before them.
SITE_WORDS = ["سایت", "اختبار"]
