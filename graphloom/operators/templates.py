"""Chat templates: prompts and training pairs of whole conversations as text, special tokens by their text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Texts around the system message, each query and between turns; places are {{system}}, {{query}} and {{idx}} (turn from 1)."""

    prefix: str
    prompt: str
    system: str = ""
    sep: str = ""
    stop_words: tuple[str, ...] = ()
    #: The separator ends an answer by itself.
    efficient_eos: bool = False
    history: bool = True
    #: The prefix is part of the first query and no separator follows it.
    folded: bool = False


A_CHAT = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
SAFE = (
    "Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. "
    "Please ensure that your responses are socially unbiased and positive in nature.\n\n"
    "If a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. "
    "If you don't know the answer to a question, please don't share false information."
)
# The public chat formats by the name of their model family.
TEMPLATES = {
    "alpaca": Template("{{system}}", "### Instruction:\n{{query}}\n\n### Response:\n", "Below is an instruction that describes a task. Write a response that appropriately completes the request.", "\n\n"),
    "aquila": Template("{{system}}", "Human: {{query}}###Assistant:", "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions.", "###", ("</s>",), True),
    "baichuan": Template("{{system}}", "<reserved_102>{{query}}<reserved_103>", efficient_eos=True),
    "baichuan2": Template("{{system}}", "<reserved_106>{{query}}<reserved_107>", efficient_eos=True),
    "openba": Template("{{system}}", "<S>{{query}}<extra_id_0>"),
    "belle": Template("{{system}}", "Human: {{query}}\n\nBelle: ", sep="\n\n"),
    "bluelm": Template("{{system}}", "[|Human|]:{{query}}[|AI|]:"),
    "chatglm2": Template("[gMASK]sop{{system}}", "[Round {{idx}}]\n\n问：{{query}}\n\n答：", sep="\n\n", efficient_eos=True),
    "chatglm3": Template("[gMASK]sop<|system|>\n{{system}}", "<|user|>\n{{query}}<|assistant|>", "You are ChatGLM3, a large language model trained by Zhipu.AI. Follow the user's instructions carefully. Respond using markdown.", "", ("<|user|>", "<|observation|>"), True),
    "deepseek": Template(
        "{{system}}", "### Instruction:\n{{query}}\n\n### Response:\n",
        "You are an AI programming assistant, utilizing the Deepseek Coder model, developed by Deepseek Company, and you only answer questions related to computer science. "
        "For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.",
        "\n<|EOT|>\n\n", ("<|EOT|>",), True,
    ),
    "default": Template("{{system}}", "Human: {{query}}\nAssistant:", A_CHAT, "\n"),
    "falcon": Template("{{system}}", "User: {{query}}\nFalcon:", sep="\n", efficient_eos=True),
    "intern": Template("{{system}}", "<|User|>:{{query}}<eoh>\n<|Bot|>:", sep="<eoa>\n", stop_words=("<eoa>",), efficient_eos=True),
    "llama2": Template("<<SYS>>\n{{system}}\n<</SYS>>\n\n", "[INST] {{query}} [/INST]", "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe. " + SAFE, folded=True),
    "llama2_zh": Template("<<SYS>>\n{{system}}\n<</SYS>>\n\n", "[INST] {{query}} [/INST]", "You are a helpful assistant. 你是一个乐于助人的助手。", folded=True),
    "mistral": Template("{{system}}", "[INST] {{query}} [/INST]", sep=" "),
    "openchat": Template("{{system}}", "GPT4 Correct User: {{query}}<|end_of_turn|>GPT4 Correct Assistant:", sep="<|end_of_turn|>", stop_words=("<|end_of_turn|>",), efficient_eos=True),
    "qwen": Template("<|im_start|>system\n{{system}}", "<|im_start|>user\n{{query}}<|im_end|>\n<|im_start|>assistant\n", "You are a helpful assistant.", "<|im_end|>\n", ("<|im_end|>",), True),
    "starchat": Template("<|system|>\n{{system}}", "<|user|>\n{{query}}<|end|>\n<|assistant|>", sep="<|end|>\n", stop_words=("<|end|>",), efficient_eos=True),
    "vanilla": Template("", "{{query}}", history=False),
    "vicuna": Template("{{system}}", "USER: {{query}} ASSISTANT:", A_CHAT),
    "xverse": Template("{{system}}", "Human: {{query}}\n\nAssistant: "),
    "yayi": Template(
        "<|System|>:\n{{system}}", "<|Human|>:\n{{query}}\n\n<|YaYi|>:",
        "You are a helpful, respectful and honest assistant named YaYi developed by Beijing Wenge Technology Co.,Ltd. Always answer as helpfully as possible, while being safe.  " + SAFE, "\n\n", ("<|End|>",),
    ),
    "zephyr": Template("<|system|>\n{{system}}</s>", "<|user|>\n{{query}}</s><|assistant|>", "You are a friendly chatbot who always responds in the style of a pirate"),
    "ziya": Template("{{system}}", "<human>:{{query}}\n<bot>:", sep="\n"),
}


def put(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return out


def pairs(turns: Column, template: str | Template, system: Column | None = None, bos: str = "", eos: str = "") -> Column:
    """An array of structs (prompt, answer), one for each turn (query, answer): what training encodes, pair by pair.

    The first prompt holds the system message (the template's, unless one is given), later ones start with the separator. Of a
    template without history only the last turn counts. Null texts are empty; no turns give no pairs.
    """
    t = TEMPLATES[template] if isinstance(template, str) else template
    told = F.lit(t.system) if system is None else F.coalesce(system, F.lit(t.system))
    head = put(t.prefix, system=told)
    if not t.history:
        turns = F.slice(turns, F.greatest(F.size(turns), F.lit(1)), 1)

    def pair(x: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        if t.folded:
            query = F.when(i == 0, F.concat(head, F.coalesce(x["query"], F.lit("")))).otherwise(x["query"])
            prompt = F.concat(F.lit(bos), put(t.prompt, query=query))
        else:
            # the places of a prompt are filled before any text of a user is in it
            start = F.when(i == 0, F.when(head == "", F.lit(bos)).otherwise(F.concat(F.lit(bos), head, F.lit(t.sep)))).otherwise(F.lit(t.sep + bos))
            prompt = F.concat(start, put(t.prompt, idx=number, query=x["query"]))
        return F.struct(prompt.alias("prompt"), F.concat(F.coalesce(x["answer"], F.lit("")), F.lit("" if t.efficient_eos else eos)).alias("answer"))

    return F.transform(turns, pair)


def chat(turns: Column, template: str | Template, system: Column | None = None, bos: str = "", eos: str = "") -> Column:
    """The whole conversation as one text; a last turn without an answer leaves the prompt open. No turns: an empty text."""
    p = pairs(turns, template, system, bos, eos)
    last_open = F.coalesce((F.size(turns) > 0) & F.get(turns, F.size(turns) - 1)["answer"].isNull(), F.lit(False))
    n = F.size(p)
    return F.array_join(F.transform(p, lambda x, i: F.when(last_open & (i == n - 1), x["prompt"]).otherwise(F.concat(x["prompt"], x["answer"]))), "")


def few_shot_prompt(instruction: str, examples: list[tuple[str, str]], question: Column, schema: str = "", labels: tuple[str, str] = ("Question", "Query")) -> Column:
    """Instruction, schema and worked examples, then the question with its answer left open."""
    ask, answer = labels
    shown = "\n\n".join(f"{ask}: {q}\n{answer}: {a}" for q, a in examples)
    head = "\n\n".join(x for x in (instruction, schema and f"Schema: {schema}", shown) if x)
    return F.concat(F.lit(head + f"\n\n{ask}: "), F.coalesce(question, F.lit("")), F.lit(f"\n{answer}: "))
