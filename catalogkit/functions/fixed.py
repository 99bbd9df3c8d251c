"""Fixed values of the curation rules: priorities, word lists, patterns, names.

They decide results, so they are kept as the catalog's conventions state them.
"""

# Priority of a source when the best record of an entity is picked; others 100; +20 with an asset.
SOURCE_PRIORITY = {"svglogo": 1000, "wikimedia": 800, "expanded-wikimedia": 750, "expanded-website-icons": 700, "gilbarbara": 650, "vectorlogozone": 600, "thesvg": 520, "car-logos": 500}
OTHER_PRIORITY = 100
ASSET_BONUS = 20

# Priority when duplicates are dropped; 0 and unknown sources count 100.
DEDUPE_PRIORITY = {"svglogo": 900, "wikimedia": 650, "gilbarbara": 550, "vectorlogozone": 500, "car-logos": 450, "thesvg": 350}
RECOMMENDED_BONUS, TITLE_BONUS, DEDUPE_ASSET_BONUS = 1000, 20, 5

CONFIDENCE_RANK = {"high": 0, "medium": 1, "low": 2}
VARIANT_RANK = {"default": 0, "light": 1, "dark": 2}
OTHER_VARIANT, WORDMARK_PENALTY = 10, 100
PREFERENCE = ("symbol_light", "symbol_dark", "icon_light", "icon_dark", "logo_light", "logo_dark")

CATEGORY_NAMES = {
    "aigc": "AIGC", "airline": "航空公司", "automotive": "汽车交通", "company": "企业品牌", "consumerBrands": "消费品牌", "cosmetic": "美妆个护", "goldJewelry": "黄金珠宝",
    "other": "其他", "pay": "金融支付", "school": "学校", "social": "社交媒体", "tools": "工具软件", "weather": "天气",
}
DENIED_CATEGORIES = ("other", "weather")
DEFAULT_CATEGORY, DEFAULT_GROUP = "其他", "未分组"
SOURCE_CATEGORY = {
    "car-logos": "汽车交通", "expanded-website-icons": "品牌机构", "expanded-wikimedia": "品牌机构", "wikimedia": "品牌机构",
    "gilbarbara": "科技互联网", "vectorlogozone": "科技互联网", "thesvg": "科技互联网",
}

# Description words -> category, the first rule that hits.
KEYWORD_CATEGORIES = (
    (("bank", "financial", "payment", "fintech", "insurance"), "金融支付"),
    (("airline", "automaker", "automobile", "car", "transport"), "汽车交通"),
    (("software", "internet", "technology", "website", "platform", "cloud"), "科技互联网"),
    (("retail", "restaurant", "food", "drink", "consumer"), "消费品牌"),
)
BUSINESS_WORDS = ("company", "brand", "corporation", "software", "bank", "airline", "retailer", "manufacturer", "website", "service", "platform", "chain", "automaker", "product", "restaurant", "store", "app", "subsidiary", "organization")
OFF_TOPIC_WORDS = ("human", "surname", "given name", "film", "song", "album", "single", "episode", "book", "fictional", "pepper", "chili", "plant", "species", "protein", "gene")
GLUED_SUFFIXES = ("bank", "cloud", "group", "labs", "pay", "app", "air", "ai", "tv", "store", "systems", "software", "technologies")
GENERIC_IDS = ("logo", "logos", "icon", "icons", "default", "color", "black", "white", "symbol", "mark", "app", "brand", "favicon", "apple_touch_icon", "og_image", "meta", "orphan")
RELIABLE_SOURCES = ("svglogo", "wikimedia", "expanded-wikimedia", "expanded-website-icons", "gilbarbara", "vectorlogozone", "thesvg", "car-logos")

LINK_KEYWORDS = ("brand assets", "media kit", "press kit", "logo", "logo package", "brand guidelines", "assets", "download")
LINK_CLASSES = (("press", "press"), ("media", "media-kit"), ("brand", "brand-assets"), ("logo", "logo"))
ELEMENT_WEIGHTS = (("brandfetch", 20), ("symbol", 220), ("icon", 160), ("logo", 80), ("wordmark", -220), ("avatar", 40))
DOMAIN_WEIGHT = 70
ICON_PRIORITY = {"apple-touch-icon": 80, "mask-icon": 60, "icon": 50, "og:image": 20}
MANIFEST_PRIORITY, LARGE_MANIFEST_PRIORITY, OTHER_ICON_PRIORITY = 85, 100, 10

IMAGE_SUFFIX = r"(?i)\.(svg|png|jpe?g|webp)$"
NAME_SUFFIX = r"(?i)(?:^|[-_\s])(icon|logo|default|color|black|white|symbol|mark)$"
SITE_ICON = r"(^|/)(favicon|apple-touch-icon|mstile|android-chrome|browserconfig|safari-pinned-tab)([-_.]|\.)"
PUBLIC_ICON = r"/public/(icon|favicon|apple-touch-icon)\.(svg|png|jpe?g|webp)$"
SIZE_ICON = r"/(logo|logos|icons?)/(16|24|32|48|64|128|256)\.(svg|png|jpe?g|webp)$"
SIZE_TITLE = r"^(16|24|32|48|64|128|256)$"
EXTENSION_FOLDER = "/extensions/"
# icons of a cloud service, by source
SERVICE_ICONS = {
    "gilbarbara": r"/aws-[^/]+\.svg$",
    "vectorlogozone": r"/amazon_aws[^/]+/amazon_aws[^/]+-icon\.svg$",
    "thesvg": r"/public/icons/aws[-_][^/]+/",
}
# what a source's primary variant looks like; others are left out, with the reason
PRIMARY_VARIANTS = {
    "thesvg": (r"/public/icons/[^/]+/(default|color)\.svg$", "thesvg_non_brand_primary_variant"),
    "vectorlogozone": (r"-icon\.svg$", "vectorlogozone_non_icon_variant"),
}
WORDMARK_NAME = r"(?:wordmark|wordmard)(?:\.(svg|png|jpe?g|webp))?$"
WORDMARK_RATIO, BOUNDS_RATIO, CELL_THRESHOLD, HASH_DISTANCE = 2.2, 2.15, 12, 4
FAR_APART = (1 << 31) - 1  # distance of hashes that cannot be compared

SCORE_TITLES = ((90, "master"), (75, "expert"), (60, "skilled"), (40, "learner"))
GROUP_MINIMUM, OPTION_COUNT, ROUND_SIZE = 4, 4, 20
ITEM_TYPES = ("logo_to_brand", "brand_to_logo")
TYPE_LABELS = {"logo_to_brand": "基础识别", "brand_to_logo": "反向记忆", "similar_logo_confusion": "相似混淆", "brand_clue_to_logo": "线索推理"}
# Quality of a collected file by its source and a word in its name; the last number: without the word.
FILE_SCORES = {"thesvg": ("wordmark", 45, 72), "vectorlogozone": ("icon", 76, 60), "gilbarbara": (None, 70, 70), "car-logos": (None, 75, 75)}
OTHER_FILE_SCORE, ERROR_SAMPLES, LARGE_FILE = 60, 300, 512 * 1024
