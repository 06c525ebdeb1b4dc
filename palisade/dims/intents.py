"""Intent definitions, policy and time constants (fixed values)."""

# (intent, minimum score, minimum clusters, required sets in order, further evidence clusters)
INTENTS = [
    ("MILITARY_SABOTAGE_RECRUITMENT", 50, 1, [["military_sabotage"]], ["military_sabotage"]),
    (
        "VERIFICATION_PHISHING", 45, 2,
        [
            ["verification_purpose", "payment_credential_request"],
            ["verification_purpose", "password_theft"],
            ["verification_purpose", "action_link"],
            ["verification_trap", "off_platform"],
            ["verification_trap", "action_link"],
            ["verification_trap", "delivery_action"],
            ["verification_trap", "urgency_pressure"],
            ["verification_trap", "password_theft"],
        ],
        ["verification_trap", "off_platform", "action_link", "delivery_action", "urgency_pressure", "password_theft",
         "verification_purpose", "payment_credential_request"],
    ),
    (
        "ESCROW_DELIVERY_SCAM", 45, 1,
        [["transaction_redirect"], ["delivery_action", "payment_claim"], ["delivery_action", "action_link"],
         ["payment_claim", "action_link"], ["delivery_action", "off_platform"]],
        ["delivery_action", "payment_claim", "action_link", "off_platform", "transaction_redirect"],
    ),
    ("OFF_PLATFORM_REDIRECT", 50, 2, [["off_platform", "off_platform_action"]], ["off_platform", "off_platform_action"]),
    (
        "PAYMENT_CREDENTIAL_THEFT", 40, 1,
        [["payment_credential_request"], ["bank_login_request", "action_link", "payment_purpose"]],
        ["payment_credential_request", "bank_login_request", "action_link", "payment_purpose"],
    ),
    ("IDENTITY_PROBING", 40, 1, [["identity_probing"]], ["identity_probing"]),
    ("CRYPTO_WALLET_COMPROMISE", 40, 1, [["crypto_phishing"]], ["crypto_phishing", "password_theft"]),
]
LOCKING = ["MILITARY_SABOTAGE_RECRUITMENT", "SEED_PHRASE_THEFT", "CRYPTO_WALLET_COMPROMISE"]
ADVISORY = ["ESCROW_DELIVERY_SCAM", "OFF_PLATFORM_REDIRECT", "VERIFICATION_PHISHING", "PAYMENT_CREDENTIAL_THEFT",
            "IDENTITY_PROBING", "URGENCY_PRESSURE"]
FINANCIAL = ["VERIFICATION_PHISHING", "PAYMENT_CREDENTIAL_THEFT", "ESCROW_DELIVERY_SCAM"]
PAYOUT_WORDS = r"(?:отримати\s+виплат|receive\s+(?:a\s+)?payout)"

SESSION_MS = 900_000
FULL_WEIGHT_MS = 60_000
HALF_LIFE_MS = 300_000
PER_DIRECTION = 30
