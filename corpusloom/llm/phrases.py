"""Parts from which synthetic defects are put together: how one declines, how one regrets and then helps, how a copy is
labelled. They are general ways of speaking, written for this purpose; no whole phrase of the test tables is among them, short runs
of common words are in both."""

from __future__ import annotations

import random

#: language -> what may come in front
OPENERS = {
    "en": ("", "", "", "Sorry. ", "My apologies, ", "I regret it, yet ", "With all respect, ", "To be frank, ", "Alas, ", "Sadly, ", "Oh dear, ", "Thank you, though ", "I see what you want, still ", "Being a mere program, ", "As an AI model, ", "As an assistant, ", "Well, ", "I hear you; "),
    "de": ("", "", "Tut mir leid, ", "Verzeihung, ", "Bedaure, ", "Schade, aber ", "Ehrlich gesagt, ", "Als Programm sage ich: "),
    "fr": ("", "", "Navré, ", "Je regrette, ", "Hélas, ", "Toutes mes excuses, ", "Franchement, ", "En tant que programme, "),
    "es": ("", "", "Lástima, ", "Lo lamento, ", "Mil disculpas, ", "Sinceramente, ", "Como programa, ", "Por desgracia, "),
    "ru": ("", "", "Жаль, но ", "Увы, ", "Прошу прощения, ", "Честно говоря, ", "Сожалею, ", "Как программа скажу: "),
    "zh": ("", "", "不好意思，", "真遗憾，", "请原谅，", "说实话，", "作为程序，", "非常抱歉，"),
}
#: language -> (who declines how, what is declined)
CORES = {
    "en": (
        (
            "I cannot assist with", "I can't respond to", "I am not able to answer", "I'm not able to reply to", "I won't engage with", "I will not comply with", "I am unable to provide", "I'm unable to discuss", "I decline to deal with", "I must decline", "I have to decline", "I refuse to work on", "I have to refuse",
            "I'd prefer to skip", "I would prefer not to address", "I would rather avoid", "I'd rather say nothing on", "I am unwilling to talk about", "I'm not comfortable with", "I feel uneasy about", "I don't feel it is right to treat", "I am not permitted to cover", "I'm not allowed to comment on", "I am forbidden to give out", "I was told to stay away from", "I have been instructed to leave out",
            "I was built so that I keep out of", "my rules do not let me touch", "my guidelines forbid", "my policy rules out", "by no means can I take on", "it's impossible for me to fulfil", "there is no way I may handle", "it goes beyond my role to judge", "it lies outside my remit to explain", "it isn't my place to give advice on", "I do not give opinions on", "I never answer", "I always turn down",
            "I shall stay silent about", "I am going to pass on", "I cannot help you with", "I can not offer any help on", "I'm afraid I can't do", "I can't be of help with", "I can't lend a hand with", "I can't speak to", "I can't go along with", "I can't give you", "sorry, but help is out of reach on", "I am of no help with", "I won't help you with", "I will not be helping with", "helping is not an option with",
        ),
        ("this matter", "your question", "such a request", "requests like that", "what you ask for", "that subject", "this type of topic", "it", "that", "anything of the kind", "questions of that sort", "the thing you describe", "your message", "this one"),
    ),
    "de": (
        ("hier helfe ich nicht bei", "ich lehne ab, zu reden über", "ich bin nicht befugt zu antworten auf", "ich darf nicht sprechen über", "es ist mir nicht erlaubt, Auskunft zu geben über", "ich will mich nicht äußern zu", "ich sehe mich außerstande zu", "mir ist es unmöglich, etwas zu sagen zu", "ich verweigere jede Antwort auf", "ich kann leider nichts beitragen zu", "ich möchte nicht eingehen auf"),
        ("so etwas", "dieses Thema", "diese Anfrage", "deine Bitte", "Fragen dieser Art", "das", "diesen Wunsch"),
    ),
    "fr": (
        ("je refuse de parler de", "je ne souhaite pas répondre à", "il ne m'est pas permis de traiter", "je n'ai pas le droit d'aborder", "je suis incapable de donner suite à", "je ne saurais aider pour", "je m'abstiens de commenter", "mes règles m'interdisent", "je dois décliner", "je ne peux rien dire sur", "impossible pour moi de fournir"),
        ("cela", "ce sujet", "votre demande", "ce genre de question", "une telle chose", "cette requête"),
    ),
    "es": (
        ("me niego a hablar de", "no deseo responder a", "no se me permite tratar", "no tengo permiso para abordar", "soy incapaz de atender", "no voy a ayudar con", "me abstengo de comentar", "mis normas me prohíben", "tengo que declinar", "no puedo decir nada sobre", "me resulta imposible ofrecer"),
        ("eso", "ese tema", "su solicitud", "ese tipo de preguntas", "tal cosa", "lo que pides"),
    ),
    "ru": (
        ("я отказываюсь обсуждать", "я не стану отвечать на", "мне запрещено говорить про", "я не имею права разбирать", "я не в состоянии выполнить", "я не буду помогать с", "мои правила не разрешают", "я вынужден отклонить", "ничего не могу сказать про", "мне невозможно ответить на", "я предпочту промолчать про"),
        ("это", "такую тему", "ваш запрос", "подобные вопросы", "такое", "эту просьбу"),
    ),
    "zh": (
        ("我拒绝讨论", "我不会回答", "我不被允许谈论", "我没有权限处理", "我没有办法完成", "我不能协助", "我的规定禁止", "我只能谢绝", "我无法提供", "我不愿意评论", "我选择不回应"),
        ("这件事", "这个话题", "你的要求", "这类问题", "这种内容", "该请求"),
    ),
}
#: whole sentences that decline
FLAT = {
    "en": ("No comment from my side.", "That is off limits here.", "You will have to look elsewhere.", "Count me out of this.", "Not something I do.", "No, not with me.", "The answer is no.", "A refusal is all I have for you.", "I have nothing to say here.", "Asking a professional would be wiser than asking me.", "Such things are not open for discussion.", "My reply must stay a no."),
    "de": ("Dazu sage ich nichts.", "Das geht mit mir nicht.", "Darüber schweige ich.", "Nein, das mache ich nicht."), "fr": ("Je n'en dirai rien.", "C'est non.", "Pas avec moi.", "Je garde le silence."),
    "es": ("De eso no hablo.", "La respuesta es no.", "Conmigo no.", "Guardo silencio."), "ru": ("Об этом я молчу.", "Мой ответ нет.", "Без меня.", "Этого я делать не стану."), "zh": ("对此我保持沉默。", "答案是不。", "这不行。", "我帮不上忙。"),
}
REASONS = {
    "en": ("", "", "", ", since it would break my rules", ", as I have no access to that", " for reasons of safety", ", because I hold no opinions", " in this conversation", " right now", ", whatever the purpose", "; I hope you understand", ", as instructed"),
    "de": ("", "", " im Moment", ", aus Gründen der Sicherheit", ", so sind meine Regeln"), "fr": ("", "", " à présent", ", pour des raisons de sécurité", ", telles sont mes règles"), "es": ("", "", " ahora mismo", ", por motivos de seguridad", ", así son mis normas"),
    "ru": ("", "", " сегодня", ", таковы мои правила", ", из соображений безопасности"), "zh": ("", "", "，这是规定", "，出于安全的考虑"),
}
LEADS = {"en": ("", "", "", "", "Thanks for writing. ", "I did read your message with care. ", "Here is the thing. ", "Nope. ", "Hello. ", "I will be open with you. ")}
CLOSERS = {
    "en": ("", "", "", " Perhaps an expert can help.", " Try someone trained in the field.", " Pick another subject, please.", " What else may I do for you?", " Shall we talk of other things?", " Feel welcome to ask me other things.", " Let us move on."),
    "de": ("", "", " Wende dich an Fachleute.", " Wählen wir etwas anderes."), "fr": ("", "", " Voyez un professionnel.", " Parlons d'autre chose."), "es": ("", "", " Acude a un profesional.", " Hablemos de otra cosa."), "ru": ("", "", " Обратитесь к знатокам.", " Давайте о другом."), "zh": ("", "", "请去问专业人士。", "我们聊别的吧。"),
}
#: a regret in front of help
REGRETS = {
    "en": ("Sorry to learn of this; here is a way forward. ", "Sadly no one knows it all, but this much is clear. ", "I can't see your case from here, so take this as a general answer. ", "I am not able to promise success, though the steps below tend to work. ", "Apologies for the delay, here you go. ", "I won't pretend it is simple: ", "I cannot give an exact number, but roughly: ", "My regrets about that. Try this: ", "I refuse to make it longer than needed. ", "I'm unable to draw it, so in words: "),
    "de": ("Schade, dass es so kam; das kann helfen. ", "Genau weiß das niemand, doch so viel steht fest. ", "Ich kann es nicht sehen, darum allgemein: ", "Verzeih die späte Antwort. "), "fr": ("Navré pour ce souci, essayez ceci. ", "Personne ne le sait au juste, mais voici l'essentiel. ", "Je ne peux pas le voir, donc en général : ", "Pardonnez ce retard. "),
    "es": ("Lamento el problema, prueba esto. ", "Nadie lo sabe con certeza, pero esto es claro. ", "No puedo verlo, así que en general: ", "Perdón por la demora. "), "ru": ("Жаль, что так вышло; вот что можно сделать. ", "Точно не знает никто, но ясно вот что. ", "Я этого не вижу, поэтому в общем: ", "Простите за задержку. "), "zh": ("很难过听到这些，可以试试下面的办法。", "没有人完全清楚，不过可以肯定的是这些。", "我看不到具体情况，所以大致说明。", "抱歉回复晚了。"),
}
COPY_LABELS = ("Question: {}", "User: {}", "**Q:** {}", "> {}", "\"{}\"", "“{}”", "*{}*", "{}\n{}", "{} {}", "\n\n{}", "You asked: {}", "Frage: {}", "Q: {}", "  {}\n", "Human: {}", "- {}", "Prompt: {}", "<p>{}</p>")
SAY_BACK = ("Repeat exactly: {}", "Please say it back: {}", "Correct the spelling where needed: {}", "Repeat word for word: {}", "Sprich genau nach: {}", "Répétez mot pour mot : {}", "Repita palabra por palabra: {}", "Повторите слово в слово: {}", "请原样重复：{}", "Copy this verbatim: {}")
ASK_IN = {"en": ("English",), "de": ("German", "Deutsch"), "fr": ("French", "français"), "es": ("Spanish", "español"), "ru": ("Russian",), "zh": ("Chinese", "中文")}


def refusal(lang: str, r: random.Random, topic: str = "", part: int | None = None) -> str:
    """One way to decline in a language, sometimes naming a word of the question; of every second way only, if ``part`` is
    0 or 1."""
    lang = lang if lang in CORES else "en"
    stop, space = ("。", "") if lang == "zh" else (".", " ")
    some = slice(None) if part is None else slice(part, None, 2)
    if r.random() < 0.15:
        text = r.choice(FLAT[lang][some])
    else:
        how, what = CORES[lang]
        how = how[some]
        named = f"{r.choice(('questions about', 'talk of', 'anything on'))} {topic}" if topic and lang == "en" and r.random() < 0.3 else r.choice(what)
        text = r.choice(OPENERS[lang]) + r.choice(how) + space + named + r.choice(REASONS[lang]) + stop
    if r.random() < 0.2:
        text += space + r.choice(FLAT[lang][some])
    text = r.choice(LEADS.get(lang, ("",))) + text[0].upper() + text[1:] + r.choice(CLOSERS[lang])
    k = r.random()
    return text.lower() if k < 0.08 else text.rstrip(".。") if k < 0.16 else text
