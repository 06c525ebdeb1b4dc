"""Rule lexicon: clusters, languages and patterns.

Fixed values: the results must equal those of the rule set, so the patterns are stated as they are.
Texts are normalised and lower-cased before matching, hence no case flag.
"""

WEIGHTS = {
    "off_platform_action": 25,
    "verification_purpose": 40,
    "delivery_action": 30,
    "payment_claim": 35,
    "action_link": 25,
    "off_platform": 35,
    "verification_trap": 40,
    "payment_purpose": 25,
    "bank_login_request": 60,
    "urgency_pressure": 20,
    "military_sabotage": 50,
    "identity_probing": 45,
    "crypto_phishing": 45,
    "password_theft": 40,
    "payment_credential_request": 60,
    "transaction_redirect": 65,
}

# Fixed values: (cluster, language, patterns).
RULES = [
    ("off_platform_action", "universal", [
        r"(?:наберіть|звяжімося|звяжіться|перейдемо|переходьте)",
    ]),
    ("verification_purpose", "universal", [
        r"(?:підтвердити|підтвердіть|підтвердження)\s+(?:покупк[а-яіїє]*|особ[а-яіїє]*)",
    ]),
    ("delivery_action", "uk", [
        r"(?:оlх|олх)[-_\s]?доставк[а-яіїє]*",
        r"(?:я\s+вже\s+)?оформи[ла-я]*(\s+замовлення)?",
        r"(?:я\s+вже\s+)?оплатив\s+(?:доставк[а-яіїє]*|замовленн[а-яіїє]*)",
        r"безпечн[а-я]\s+угод[а-я]",
        r"перш[а-я]\s+угод[а-я]",
        r"оплат[а-я]\s+(внесен[а-я]|успішн[а-я]|списан[а-я])",
    ]),
    ("delivery_action", "ru", [
        r"(?:оlх|олх)[-_\s]?доставк[а-яё]*",
        r"(?:я\s+уже\s+)?оформил[а-яё]*(\s+заказ)?",
        r"безопасн[а-яё]+\s+сделк[а-яё]+",
        r"перв[а-яё]+\s+сделк[а-яё]+",
        r"оплат[а-яё]+\s+(внесен[а-яё]+|успешн[а-яё]+|списан[а-яё]+)",
    ]),
    ("delivery_action", "en", [
        r"(?:olx|ebay|etsy|vinted|fedex|dhl|ups)[-_\s]?(?:delivery|shipping|escrow|service)",
        r"(?:i\s+have\s+|i'?ve\s+)?(?:already\s+)?(?:paid|ordered|placed\s+(?:an?\s+)?order)",
        r"secure\s+(?:deal|transaction|escrow)",
        r"payment\s+(?:made|completed|successful|processed|charged|received)",
    ]),
    ("payment_claim", "uk", [
        r"(?:до\s+)?отриманн[яі](\s*кошт[а-я]*|\s*грош[а-я]*)?",
        r"отримати\s+(кошт[а-я]*|грош[а-я]*)",
        r"підтвердити\s+виплату",
        r"забер(?:іть|и)\s+(?:(?:свої|ваші)\s+)?(?:кошти|грош[а-яіїє]*)",
        r"підтвердженн[яі]\s+(?:виплат[а-яіїє]*|зарахуванн[яі]\s+оплат[а-яіїє]*)",
        r"зарезервува[а-яіїє]*\s+оплат[а-яіїє]*",
        r"отримати\s+передоплат[а-яіїє]*",
        r"зарахуванн[яі]\s+кошт[а-я]*",
    ]),
    ("payment_claim", "ru", [
        r"(?:к\s+)?получени[еюя](\s*средств[а-яё]*|\s*денег|\s*денежн[а-яё]*)?",
        r"получить\s+(средств[а-яё]*|деньги|выплату)",
        r"подтвердить\s+выплату",
        r"зачислени[ею]\s+(средств|денег)",
    ]),
    ("payment_claim", "en", [
        r"(?:to\s+)?(?:receive|collect|claim|accept|withdraw)\s+(?:your\s+)?(?:funds|money|payment|payout)",
        r"confirm\s+(?:payment|payout|transfer|disbursement)",
        r"funds?\s+(?:credited|ready\s+to\s+claim)",
    ]),
    ("action_link", "uk", [
        r"(?:перейдіть|перевірте|виділіть|вставте|відкрийте|тисніть|клікніть|ось)\s*(?:за\s+)?(?:цим\s+)?(?:посиланн[яі]|лінк[а-я]*)",
        r"посиланн[яі]|лінк[а-я]*",
    ]),
    ("action_link", "ru", [
        r"(?:перейдите|проверьте|выделите|вставьте|откройте|нажмите|кликните|вот)\s*(?:по\s+)?(?:этой\s+)?(?:ссылк[еи]|линк[уе]*)",
        r"ссылк[а-яё]*|линк[а-яё]*",
    ]),
    ("action_link", "en", [
        r"(?:go\s+to|click|open|follow|paste|visit|check)\s*(?:on\s+)?(?:this\s+)?(?:link|url|website|page)",
        r"follow\s+(?:the\s+)?link",
        r"(?:click\s+here|tap\s+here)\s+(?:to\s+)?(?:confirm|receive|verify)",
    ]),
    ("action_link", "universal", [
        r"https?://[^\s]+",
        r"htt[pр]s?://[^\s]+",
    ]),
    ("off_platform", "uk", [
        r"вайбер|vіbеr|viber|телеграм|tеlеgrаm|tеlеgram|telegram|sіgnаl|signal|в\s+тг|чат-?бот[а-яіїє]*|[ув]\s+боті?|ботом|whаtsарр|whatsарр|whatsapp|ватсап",
    ]),
    ("off_platform", "ru", [
        r"вайбер|vіbеr|viber|телеграм|tеlеgrаm|telegram|sіgnаl|signal|в\s+тг|чат-?бот[а-яё]*|[вво]\s+боте?|ботом|whаtsарр|whatsapp|ватсап|вотсап",
        r"напишите\s+в\s+(?:вайбер|телеграм|тг|ватсап)",
    ]),
    ("off_platform", "en", [
        r"whatsapp|telegram|viber|signal|in\s+(?:tg|wa)|chat-?bot",
        r"(?:message|write|contact)\s+(?:me\s+)?(?:on|in)\s+(?:whatsapp|telegram|viber|signal)",
    ]),
    ("off_platform", "universal", [
        r"t\.mе/[a-z0-9_]+",
        r"wа\.mе/[0-9]+",
    ]),
    ("off_platform_action", "uk", [
        r"(?:переходь|переходьте|перейдіть|переходимо|перейдемо|перейти|продовжимо|продовжуймо|продовжуйте|напишіть|напиши|пишіть|пиши|залиште|залишіть|зв['’ʼ]?яжіться|зв['’ʼ]?яжись|зв['’ʼ]?яжуся|зателефонуйте|зателефонуй|скиньте|скинь|надішліть|надішли|обміняймося|обміняємося|обміняйтеся|підтвердіть|давайте\s+(?:перейдемо|продовжимо))",
        r"посилання\s+на\s+(?:мій\s+)?профіл[а-яіїє]*",
        r"(?:через|у|в)\s+(?:наш\s+)?чат-?бот[^.!?\n]{0,80}(?:надішле|отримаєте|отримати|інструкц)",
    ]),
    ("off_platform_action", "ru", [
        r"(?:переходите|перейдите|переходим|перейд[её]м|перейти|продолжим|продолжайте|напишите|пиши|оставьте|оставить|свяжитесь|позвоните|скиньте|пришлите|давайте\s+перейд[её]м)",
    ]),
    ("off_platform_action", "en", [
        r"(?:^|[^a-z0-9_])(?:let['’]?s\s+(?:move|switch|continue)|(?:move|switch|continue)\s+(?:this\s+)?(?:conversation|chat)|(?:message|text|contact|call|write|send)\s+(?:me|us|your|the))(?:[^a-z0-9_]|$)",
    ]),
    ("verification_trap", "uk", [
        r"перевірк[а-я](\s*(профіл[а-я]|даних|картк[а-я]))?",
        r"верифікаці[а-я](\s*(профіл[а-я]|даних|картк[а-я]))?",
        r"номер\s+картки|код\s+безпеки|сvv|сvс|баланс\s+на\s+картці|залишок\s+коштів",
        r"пароль\s+з\s+смс|код\s+з\s+смс|підтвердження\s+банку",
        r"(?:верифікаці[яї]|перевірк[а-яіїє]+)\s+(?:акаунт[а-яіїє]*|профіл[а-яіїє]*)[^.!?\n]{0,80}(?:парол|код)",
        r"(?:введіть|надішліть|скиньте|вкажіть|надайте|введи|надішли)\s+(?:ваш\s+|свій\s+)?пароль\s+(?:на\s+сторінці|за\s+посиланням)[^!?\n]{0,140}(?:віднов\w*|підтвердж\w*|верифікац\w*|перевірк\w*)",
    ]),
    ("verification_trap", "ru", [
        r"проверк[а-яё]+(\s*(профил[яе]|данных|карт[ые]))?",
        r"верификаци[яи]+(\s*(профил[яе]|данных|карт[ые]))?",
        r"номер\s+карты|код\s+безопасности|cvv|cvc|баланс\s+на\s+карте|остаток\s+средств",
        r"пароль\s+из\s+смс|код\s+из\s+смс|подтверждение\s+банка",
        r"(?:введите|пришлите|скиньте|укажите|предоставьте)\s+(?:ваш\s+|свой\s+)?пароль\s+(?:на\s+странице|по\s+ссылке)[^!?\n]{0,140}(?:восстанов\w*|подтвержд\w*|верификац\w*|провер\w*)",
    ]),
    ("verification_trap", "en", [
        r"verif(?:y|ication)\s+(?:profile|account|card|data|identity)",
        r"card\s+number|security\s+code|cvv|cvc|card\s+balance|available\s+balance",
        r"sms\s+code|confirmation\s+code|bank\s+confirmation|one-time\s+password|otp",
        r"(?:verify|verification)\s+(?:your\s+)?(?:account|profile)[^.!?\n]{0,80}(?:password|code)",
        r"(?:enter|provide|send|share|type)\s+(?:your\s+)?password\s+(?:on\s+this\s+page|on\s+the\s+page|at\s+this\s+link)[^!?\n]{0,140}(?:restore|recover|confirm|verify|validate)",
    ]),
    ("verification_purpose", "universal", [
        r"(?:підтвердіть|підтвердити|підтвердите|підтвердженн[яюі]|перевірк[а-яіїє]*|перевірити|перевірте|перевірили|верифікаці[а-яіїє]*)\s+(?:(?:ваш[а-яіїє]*|свій)\s+)?(?:профіл[а-яіїє]*|акаунт[а-яіїє]*|вхід|замовлення|картк[а-яіїє]*|платеж[а-яіїє]*)",
        r"(?:подтвердите|подтвердить|подтверждени[яюе]|проверк[а-яё]*|проверить|проверьте|проверили|верификаци[а-яё]*)\s+(?:ваш[а-яё]*\s+)?(?:профил[а-яё]*|аккаунт[а-яё]*|вход|заказ[а-яё]*|карт[а-яё]*|платеж[а-яё]*)",
        r"(?:verify|verification\s+of|confirm|confirmation\s+of)\s+(?:your\s+)?(?:account|profile|login|order|card|payment)",
        r"(?:для\s+(?:завершення|прохождения|завершения)\s+(?:перевірки|проверки|верифікації|верификации)|(?:служба\s+безпеки|служба\s+безопасности)[^\n]{0,65}(?:скасування|отмены)\s+(?:підозрілої|подозрительной)\s+операці[їи])",
    ]),
    ("payment_purpose", "universal", [
        r"(?:отримати|отримання|зарахування)\s+(?:оплат[а-яіїє]*|кошт[а-яіїє]*|грош[а-яіїє]*|виплат[а-яіїє]*)",
        r"(?:получить|получения|зачисления)\s+(?:оплат[а-яё]*|средств|денег|выплат[а-яё]*)",
        r"(?:receive|collect|claim)\s+(?:your\s+)?(?:payment|payout|money|funds)",
        r"(?:покупець\s+оплатив|покупатель\s+оплатил|buyer\s+(?:can\s+)?pay)",
    ]),
    ("bank_login_request", "universal", [
        r"(?:авторизуйтеся|увійдіть|введіть\s+(?:логін|пароль))\s+(?:в|у|до|від)\s+(?:вашого\s+|свого\s+)?банк[а-яіїє]*",
        r"(?:авторизуйтесь|войдите|введите\s+(?:логин|пароль))\s+(?:в|от)\s+(?:вашего\s+)?банк[а-яё]*",
        r"(?:log\s*in|sign\s*in)\s+(?:to|at)\s+(?:your\s+)?bank",
    ]),
    ("urgency_pressure", "uk", [
        r"статус[іа]?\s+очікуванн[яі]",
        r"доки\s+перевірка\s+не\s+буде\s+завершен[а-я]",
        r"термінов[оа]|прямо\s+зараз|протягом\s+\d+\s+хвилин|залишилося\s+мало\s+часу",
        r"анулюється|швидше\s+підтвердіть",
    ]),
    ("urgency_pressure", "ru", [
        r"статус[еа]?\s+ожидани[яе]",
        r"пока\s+проверка\s+не\s+будет\s+завершен[а-яё]",
        r"срочн[оа]|прямо\s+сейчас|в\s+течение\s+\d+\s+минут|осталось\s+мало\s+времени",
        r"аннулируется|быстрее\s+подтвердите",
    ]),
    ("urgency_pressure", "en", [
        r"pending\s+status|awaiting\s+verification",
        r"until\s+verification\s+is\s+complete",
        r"urgently|right\s+now|within\s+\d+\s+minutes|running\s+out\s+of\s+time",
        r"will\s+be\s+cancelled|confirm\s+immediately|hurry\s+up",
    ]),
    ("military_sabotage", "uk", [
        r"(?:підпал[а-яіїє]*|спали|спалити|підпали|підпалюєш)\s*(?:[а-яіїє\s]{0,20})?(?:авто|машин|бус|колес|потяг|релейн|шаф|технік|пікап|джип|двері|будівл|тцк|воєнкомат)",
        r"(?:купуєш|купи|візьми|знайди)\s*(?:розпалювач|бензин|розчинник|запальн)",
        r"(?:розпалювач|коктейл[ья]\s*молотов[а-яіїє]*)\s*(?:[а-яіїє\s]{0,25})?(?:підпал|горінн|колес|бус|авто)",
        r"релейн[а-яіїє]*\s*шаф",
        r"(?:фото|сфотографуй|відео|зніми|зняти|сфоткай|моніторинг)\s*(?:[а-яіїє\s]{0,25})?(?:тцк|воєнкомат|військкомат|підстанц|тец|гес|трансформатор|релейн|блокпост|в/ч|частин[иа]|баз[иа]|склад|дислокац|госпітал|шпиталь)",
        r"(?:номери|номер|фото|авто|машин[а-яіїє]*)\s*(?:[а-яіїє\s]{0,20})?(?:з\s*зеленими\s*хрестами|з\s*пікселем|чорні\s*номери|військов[а-яіїє]*\s*авто)",
        r"(?:будівл[а-яіїє]*|бус[а-яіїє]*|машин[а-яіїє]*)\s*(?:[а-яіїє\s]{0,10})?(?:тцк|воєнкомат|військкомат)",
        r"кур['’ʼ’]?є[а-яіїє]*[- ]?розвідник[а-яіїє]*",
        r"(?:розвідк[а-яіїє]*|розвідник[а-яіїє]*)\s*(?:для\s*роботи|завдання|оплата|крипт)",
        r"(?:координат[а-яіїє]*|розташуванн[а-яіїє]*)\s*(?:[а-яіїє\s]{0,20})?(?:ппо|баз|частин|в/ч|склад|дислокац|технік|військ|батаре|радар)",
        r"(?:де\s*стоїть|де\s*знаходиться)\s*(?:ппо|технік|військ|частин|радар|склад)",
        r"плачу\s*(?:за|в)\s*(?:крипт|гривн|usdt|долар|бакс|фото|відео)\s*(?:[а-яіїє\s]{0,25})?(?:шаф|підпал|координат|тцк|бус|колес|фото|відео|звіт)",
        r"(?:аванс[а-яіїє]*|оплат[а-яіїє]*)\s*(?:[а-яіїє\s]{0,20})?(?:за\s*підпал|за\s*фото|за\s*координати|після\s*відео\s*горіння)",
    ]),
    ("military_sabotage", "ru", [
        r"(?:поджог[а-яё]*|подожги|подожгите|сжечь|поджигаешь)\s*(?:[а-яё\s]{0,20})?(?:авто|машин|бус|колес|поезд|релейн|шкаф|техник|пикап|джип|двер|здани|тцк|военкомат)",
        r"(?:купи|купишь|возьми)\s*(?:разжигатель|бензин|растворитель|зажигат)",
        r"(?:фото|сфотографируй|видео|сними|снять|сфоткай|мониторинг)\s*(?:[а-яё\s]{0,25})?(?:тцк|военкомат|подстанц|тэц|гэс|трансформатор|релейн|блокпост|в/ч|част[ейи]|баз[ыа]|склад|дислокац|госпитал)",
        r"(?:номера|номер|фото|авто|машин[а-яё]*)\s*(?:[а-яё\s]{0,20})?(?:с\s*зелеными\s*крестами|с\s*пикселем|черные\s*номера|военн[а-яё]*\s*авто)",
        r"(?:здани[ея]|бус[а-яё]*|машин[а-яё]*)\s*(?:[а-яё\s]{0,10})?(?:тцк|военкомат)",
        r"курьер[а-яё]*[- ]?разведчик[а-яё]*",
        r"(?:где\s*стоит|где\s*находится)\s*(?:пво|техник|воен|част|радар|склад)",
        r"(?:координат[а-яё]*|расположени[ея])\s*(?:[а-яё\s]{0,20})?(?:пво|баз|частей|в/ч|склад|дислокац|техник|воен|батаре|радар)",
        r"плачу\s*(?:за|в)\s*(?:крипт|рубл|гривн|usdt|доллар|бакс|фото|видео)\s*(?:[а-яё\s]{0,25})?(?:шкаф|поджог|координат|тцк|бус|колес|фото|видео|отчет)",
        r"(?:аванс[а-яё]*|оплат[а-яё]*)\s*(?:[а-яё\s]{0,20})?(?:за\s*поджог|за\s*фото|за\s*координаты|после\s*видео\s*горения)",
    ]),
    ("military_sabotage", "universal", [
        r"(?:знайдіть|знайди|передайте|надішліть)\s+(?:[а-яіїє\s]{0,25})?графік\s+(?:руху|переміщення)\s+(?:військов[а-яіїє]*\s+)?технік[а-яіїє]*",
        r"(?:закласти|закладіть|заклади)\s+(?:вибухов[а-яіїє]*\s+)?пристр[а-яіїє]*\s+(?:[а-яіїє\s]{0,25})?військов[а-яіїє]*",
        r"(?:зніміть|зніми|сфотографуйте|сфотографуй)\s+(?:[а-яіїє\s]{0,25})?(?:ппо|військов[а-яіїє]*\s+(?:обєкт|технік|позиці))",
        r"(?:допоможіть\s+|допоможи\s+)?(?:пошкодити|пошкодьте|знищити|знищіть)\s+військов[а-яіїє]*\s+(?:транспорт|технік|обєкт)",
        r"(?:pay|hire|recruit)\s+(?:[a-z\s]{0,25})?couriers?\s+to\s+(?:collect|gather)\s+(?:[a-z\s]{0,25})?(?:reconnaissance|intelligence)\s+(?:[a-z\s]{0,25})?military\s+(?:sites|positions|bases)",
    ]),
]
