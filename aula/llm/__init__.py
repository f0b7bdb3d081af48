"""aula.llm"""
