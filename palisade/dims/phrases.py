"""Fixture sentences planted into the conversations table (own wording).

Columns: k, lang, kind, text, expected_type, assessment.
"""

_THREAT = [
    ("en", "Please verify your account, click this link https://id-check.example-pay.com", "VERIFICATION_PHISHING"),
    ("en", "Message me on telegram and we will agree there", "OFF_PLATFORM_REDIRECT"),
    ("en", "Please send me the cvv of your card right now", "PAYMENT_CREDENTIAL_THEFT"),
    ("en", "Please provide your passport number", "IDENTITY_PROBING"),
    ("en", "Enter your seed phrase here", "CRYPTO_WALLET_COMPROMISE"),
    ("en", "Payment completed. Click here to receive your payment: go to this link", "ESCROW_DELIVERY_SCAM"),
    ("en", "To receive your payout send the card number and the security code", "PAYMENT_CREDENTIAL_THEFT"),
    ("en", "For account verification enter your password on this page to confirm the profile", "VERIFICATION_PHISHING"),
    ("en", "Tell me your mothers maiden name", "IDENTITY_PROBING"),
    ("en", "Lets move this conversation to whatsapp, write me there", "OFF_PLATFORM_REDIRECT"),
    ("uk", "Підтвердіть ваш профіль і надішліть код з смс сюди", "VERIFICATION_PHISHING"),
    ("uk", "Я вже оплатив замовлення, перейдіть за посиланням для отримання коштів", "ESCROW_DELIVERY_SCAM"),
    ("uk", "Напишіть мені у вайбер, там зручніше", "OFF_PLATFORM_REDIRECT"),
    ("uk", "Надішліть фото паспорта та ІПН", "IDENTITY_PROBING"),
    ("uk", "Введіть сід фразу гаманця на сторінці", "CRYPTO_WALLET_COMPROMISE"),
    ("uk", "Для отримання оплати вкажіть номер картки та cvv", "PAYMENT_CREDENTIAL_THEFT"),
    ("uk", "Сфотографуй блокпост і надішли координати військової техніки", "MILITARY_SABOTAGE_RECRUITMENT"),
    ("uk", "О п л а т а внесена, д.о.с.т.а.в.к.а 0лx чекає: https://olx.example-shop.com/pay?id=7", "ESCROW_DELIVERY_SCAM"),
    ("uk", "Перейдіть у v1ber і напишіть на мій номер", "OFF_PLATFORM_REDIRECT"),
    ("uk", "Покупець зарезервував суму, посилка чекає. Підтвердження виплати за посиланням: відкрийте його", "ESCROW_DELIVERY_SCAM"),
    ("ru", "Подтвердите ваш аккаунт и пришлите код из смс сюда", "VERIFICATION_PHISHING"),
    ("ru", "Я уже оформил заказ, перейдите по ссылке чтобы получить деньги", "ESCROW_DELIVERY_SCAM"),
    ("ru", "Напишите мне в телеграм, это быстрее", "OFF_PLATFORM_REDIRECT"),
    ("ru", "Пришлите серию документа и номер паспорта, это срочно", "IDENTITY_PROBING"),
    ("ru", "Для получения выплаты введите пароль и номер карты", "PAYMENT_CREDENTIAL_THEFT"),
    ("uk", "Шукаємо курєрів, зроби фото будівлі тцк, оплата в крипті", "MILITARY_SABOTAGE_RECRUITMENT"),
]
_SAFE = [
    ("en", "Never send your password to anybody"),
    ("en", "The parcel was delivered on monday, thank you"),
    ("en", "Example of a trick: \"send your pin\""),
    ("en", "I have already paid for the tickets"),
    ("uk", "Не надсилайте cvv нікому"),
    ("uk", "Дякую, посилка вже приїхала додому"),
    ("uk", "Шахрай написав: «надішліть пароль»"),
    ("uk", "Не переходьте у вайбер, це шахраї"),
    ("uk", "Перевірте баланс самостійно у своєму кабінеті"),
    ("ru", "Это было вчера, спасибо за доставку"),
    ("ru", "Никогда не сообщайте код незнакомым"),
    ("uk", "Профіль перевірено, все гаразд"),
]
_AMBIGUOUS = [
    ("en", "Could you check the account and tell me later?"),
    ("en", "What is the best number to call you?"),
    ("uk", "Надішліть, будь ласка, дані сюди"),
    ("uk", "Вкажіть адресу для кур'єра"),
    ("uk", "Ось посилання: olx-pay (крапка) com (крапка) ua"),
    ("en", "See secure [.] payment [.] com for details"),
]
_ASSET = [
    ("en", "My card is 4111 1111 1111 1111"),
    ("en", "cvv 452"),
    ("uk", "термін дії 08/28"),
    ("uk", "Ось код з смс 8492"),
    ("en", "password: Qwerty2026 ok"),
    ("uk", "Я тут 50.45010, 30.52340"),
    ("en", "My seed phrase: apple river stone cloud table green mouse light paper chair water house"),
    ("uk", "мій телефон: +380 67 123 45 67, пошта olena.k@example.com"),
    ("uk", "Мене звати Олена Коваленко, адреса: вул. Садова, 12"),
    ("en", "iban UA213223130000026007233566001 and card 5500-0055-5555-5559"),
    ("en", "123"),
    ("uk", "карта 4000056655665556 діє до 11/27 код cvv 777"),
    ("uk", "вартість 1500 грн, домовились"),
    ("en", "passport AB123456, tax id 3012345678, date of birth 01.02.1990"),
    ("en", "key sk-abcdefghijklmnopqrstuvwxyz and @some_handle"),
    ("en", "open https://shop.example.com/checkout/item77?user=olena then"),
]

PHRASES: list[tuple] = []
for _group, _assessment in ((_THREAT, "threat"), (_SAFE, "safe"), (_AMBIGUOUS, "ambiguous"), (_ASSET, "safe")):
    for _row in _group:
        _kind = "asset" if _group is _ASSET else _assessment
        PHRASES.append((len(PHRASES), _row[0], _kind, _row[1], _row[2] if len(_row) > 2 else None, _assessment))

CYCLE = 97
GAPS_MS = (20_000, 180_000, 360_000, 960_000)
EPOCH_MS = 1_704_067_200_000
AHEAD_MS = 600_000  # some messages are stamped ahead of the clock, see FUTURE
FUTURE = "(conv_id * 5 + turn * 3) % 41 = 7"
