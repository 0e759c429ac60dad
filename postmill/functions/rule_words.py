"""Word lists of the rule cascade. Results depend on every entry."""

FORM_SENDER = "notifications@fillout.com"
FORM_SUBJECT = "warranty claim form"
SYSTEM_MAILERS = ("mailer@shopify.com",)
CHAT_RELAY = "mailer@vanchat.io"
PAYMENT_SENDERS = ("@paypal.com", "@paypal.com.hk")
MARKET_SENDERS = ("@amazon.com", "@amazon.co.uk", "@amazon.ca")
POSTAL_SENDERS = ("ecship", "ec-ship", "no_reply@", "@hongkongpost.hk", "@hkpost.com")
B2B_DOMAINS = (
    "@members.wayfair.com", "@wayfair.com", "@spacious.hk", "@hongkongpost.hk", "@hkpost.com", "@qq.com",
    "@flexport.com", "@supplychain.amazon.com", "@reddit.com", "@redditmail.com", "@openai.com",
    "@composio.dev", "@photobucket.com", "@3cx.net", "@loopreturns.com", "@tryredoservice.com",
    "@deliverr.com", "@outbrain.com", "@teads.com", "@einpresswire.com", "@elixa.app",
    "@blacksheeprestaurants.com", "@gs1hk.org",
)
B2B_ADDRESSES = ("gemini-notes@google.com",)
BULK_PREFIXES = ("noreply@", "no-reply@", "donotreply@", "mailer-daemon@")

PITCH_WORDS = ("portfolio", "creative", "content creation", "media", "agency", "services", "proposal")
PROMO_SUBJECTS = (
    "you'll love", "up to % off", "deals", "steals", "update your card", "listings based on your search",
    "% off", "find out why", "competitors", "pr distribution", "press release", "media outreach",
    "growth service",
)
EVENT_WORDS = ("exhibition", "trade show", "event invitation", "conference", "webinar", "seminar", "workshop")
B2B_WORDS = (
    "invoice", "do not reply", "pirateship", "partnership", "wholesale", "our products", "introducing our",
)
PROMO_WORDS = (
    "promotion", "promotional", "payout", "discount", "marketing", "newsletter", "unsubscribe", "campaign",
    "special offer", "limited time", "flash sale", "payment received", "funds transferred", "earnings",
    "affiliate", "advertisement", "marketing pitch", "sales outreach", "partnership proposal",
    "bulk supplier", "sponsored", "limited time offer",
)

RELAY_CUSTOMER_WORDS = (
    "order", "shipping", "delivery", "return", "warranty", "case", "iphone", "product", "purchase",
    "tracking", "refund", "broken", "damaged", "waterproof", "magsafe", "compatibility", "pre-order",
    "preorder", "out of stock", "address", "modify", "cancel", "exchange", "replace",
)
RELAY_SYSTEM_WORDS = (
    "system", "alert", "report", "configuration", "status", "notification", "uptime", "performance",
    "error", "log", "webhook", "integration", "setup",
)
PAYMENT_DISPUTE_WORDS = (
    "chargeback", "dispute", "claim", "unauthorized transaction", "item not received", "not as described",
    "buyer protection", "case opened", "case update", "resolution center", "reversal", "hold",
)
MARKET_DISPUTE_WORDS = (
    "chargeback", "dispute", "case", "claim", "unauthorized", "transaction disputed", "a-to-z", "a to z",
    "refund request",
)
# The region words differ between the rules on purpose.
FORM_REGION_WORDS = ("lifestyle", "international", "overseas", "hk")
PAYMENT_REGION_WORDS = ("lifestyle", "international", "hk")
MARKET_REGION_WORDS = ("lifestyle", "international")
STATUS_REGION_WORDS = ("lifestyle", "international", "hk")
STATUS_PHRASES = (
    "where is my order", "where's my order", "where is my package", "where's my package",
    "haven't received", "have not received", "still haven't received", "not yet received",
    "track my order", "tracking number", "where is it", "has it shipped", "has my order shipped",
    "when will it arrive", "when will i receive", "when will i get", "what's the status of my order",
    "status of my order",
)

MACHINE_SENDERS = (
    "noreply", "no-reply", "no_reply", "donotreply", "notifications@", "mailer-daemon", "automated",
    "system", "alert", "postmaster",
)

URGENT_WORDS = ("urgent", "asap", "emergency", "need this today")
THREAT_WORDS = (
    "lawyer", "sue", "attorney", "bbb", "chargeback", "1 star", "amazon review", "social media",
)

# Style checks of a draft: phrases are matched without regard to case, as whole words.
BANNED_PHRASES = (
    "i pulled up", "i checked", "i can see", "i'll", "i've", "i was able to",
    "certainly", "absolutely", "of course", "definitely", "great question",
    "i understand your frustration", "i apologize for any inconvenience", "rest assured",
    "please don't hesitate", "feel free to", "i hope this helps", "i hope this email finds you well",
    "as per", "kindly", "revert back", "at your earliest convenience",
    "delve", "unlock", "unleash", "harness", "foster", "elevate", "revolutionize", "transform", "empower",
    "underscore", "interplay", "synergy",
    "in conclusion,", "furthermore,", "moreover,", "in addition,", "however, it is important to note",
    "on the other hand,", "in summary,", "essentially,", "ultimately,", "lastly,", "transitioning to",
    "let's explore",
    "comprehensive", "robust", "dynamic", "crucial", "essential", "pivotal", "paramount", "invaluable",
    "tapestry", "testament", "landscape", "nuanced",
    "dive in", "look no further", "in today's fast-paced world", "in the ever-evolving world of",
    "think of it as", "wholistic", "holistic", "endeavor", "commence", "demystify",
    "meticulous", "multifaceted",
    "realm", "journey", "navigate", "beacon", "bridges the gap", "game-changer",
)
# A phrase with a gap between its two halves.
BANNED_GAPPED = ("not only", "but also")
