"""Column functions: text, web pages and addresses, model replies, prompts."""
